"""tessella.operators"""
