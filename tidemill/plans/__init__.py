"""tidemill.plans"""
