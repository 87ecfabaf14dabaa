"""bytefold.plans"""
