"""kinweft.operators"""
