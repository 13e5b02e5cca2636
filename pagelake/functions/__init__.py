"""pagelake.functions"""
