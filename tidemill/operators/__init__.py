"""tidemill.operators"""
