"""tokenfjord.streaming"""
