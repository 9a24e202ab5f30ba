"""tidemill.streaming"""
