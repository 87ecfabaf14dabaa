"""bytefold.streaming"""
