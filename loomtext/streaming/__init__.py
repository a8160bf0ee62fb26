"""loomtext.streaming"""
