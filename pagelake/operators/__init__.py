"""pagelake.operators"""
