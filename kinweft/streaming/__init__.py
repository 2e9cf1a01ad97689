"""kinweft.streaming"""
