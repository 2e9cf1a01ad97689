"""kinweft.sources"""
