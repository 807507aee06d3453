"""tarn.streaming"""
