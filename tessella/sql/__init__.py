"""tessella.sql"""
