"""tessella.streaming"""
