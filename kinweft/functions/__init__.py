"""kinweft.functions"""
