"""pagelake.streaming"""
