"""tokenfjord.functions"""
