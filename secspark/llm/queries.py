"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from secspark.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from secspark.llm.media import op6_media
from secspark.llm.mixing import op7_mixing
from secspark.llm.near_dedup import OP9_SQL, op9_near_dedup
from secspark.llm.packing import op8_packing
from secspark.llm.pii import op1_pii
from secspark.llm.quality import op10_quality
from secspark.llm.suffix_tree import op2_suffix_tree
from secspark.llm.token_counts import op3_token_counts
from secspark.llm.warc import OP5_SQL, op5_warc

QUERIES = {f.__name__: f for f in (op1_pii, op2_suffix_tree, op3_token_counts, op4_exact_dedup, op5_warc, op6_media, op7_mixing, op8_packing, op9_near_dedup, op10_quality)}
ORACLE_SQL = {"op4_exact_dedup": OP4_SQL, "op5_warc": OP5_SQL, "op9_near_dedup": OP9_SQL}
