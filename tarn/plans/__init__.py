"""tarn.plans"""
