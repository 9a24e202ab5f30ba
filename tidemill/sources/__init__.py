"""tidemill.sources"""
