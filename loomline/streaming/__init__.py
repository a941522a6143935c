"""loomline.streaming"""
