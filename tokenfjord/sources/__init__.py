"""tokenfjord.sources"""
