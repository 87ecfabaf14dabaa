"""bytefold.sources"""
