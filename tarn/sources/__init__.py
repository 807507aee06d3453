"""tarn.sources"""
