"""The queries of this subpackage, and SQL where SQL can express them."""

from tarn.llm.bpe import op2_bpe
from tarn.llm.centroids import OP13_SQL, op13_centroids
from tarn.llm.debruijn import OP12_SQL, op12_debruijn
from tarn.llm.embedding_join import op3_embedding_join
from tarn.llm.fim import OP11_SQL, op11_fim
from tarn.llm.html_extract import op4_html_extract
from tarn.llm.kd_shards import op10_kd_shards
from tarn.llm.ngram_join import op6_ngram_join
from tarn.llm.oracles import CHECKS, CHECKS_SQL, OP3_SQL, OP6_SQL, OP8_SQL
from tarn.llm.packing import op5_packing
from tarn.llm.pii import op9_pii
from tarn.llm.quality_rules import op7_quality_rules
from tarn.llm.suffix_dedup import op8_suffix_dedup
from tarn.llm.url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_bpe": op2_bpe,
    "op3_embedding_join": op3_embedding_join,
    "op4_html_extract": op4_html_extract,
    "op5_packing": op5_packing,
    "op6_ngram_join": op6_ngram_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_pii": op9_pii,
    "op10_kd_shards": op10_kd_shards,
    "op11_fim": op11_fim,
    "op12_debruijn": op12_debruijn,
    "op13_centroids": op13_centroids,
    **CHECKS,
}
ORACLE = {"op1_url_filter": OP1_SQL, "op3_embedding_join": OP3_SQL, "op6_ngram_join": OP6_SQL, "op8_suffix_dedup": OP8_SQL, "op11_fim": OP11_SQL, "op12_debruijn": OP12_SQL, "op13_centroids": OP13_SQL, **CHECKS_SQL}
