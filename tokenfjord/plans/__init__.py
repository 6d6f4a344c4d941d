"""tokenfjord.plans"""
