"""bytefold.operators"""
