"""tarn: a PySpark-native document-guide analytics engine.

Everything outside ``tarn.llm`` is the engine proper: tolerant table loading,
listing, counting, keyword search, routing, templated answers, chat history
and a data-quality tier.  ``tarn.llm`` adds training-data operators and is
optional: nothing here imports it.
"""
