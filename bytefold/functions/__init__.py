"""bytefold.functions"""
