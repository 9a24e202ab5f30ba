"""tidemill.functions"""
