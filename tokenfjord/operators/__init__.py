"""tokenfjord.operators"""
