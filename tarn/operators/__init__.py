"""tarn.operators"""
