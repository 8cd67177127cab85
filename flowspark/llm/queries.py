"""The registered queries of this folder: name -> (query, SQL for DuckDB or None)."""

from flowspark.llm.decontaminate import op2_decontaminate
from flowspark.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from flowspark.llm.jaccard_join import op6_jaccard_join
from flowspark.llm.language import op13_language
from flowspark.llm.licenses import op8_licenses
from flowspark.llm.line_dedup import op9_line_dedup
from flowspark.llm.nearest import op7_nearest
from flowspark.llm.packing import op1_packing
from flowspark.llm.suffix_dedup import op4_suffix_dedup
from flowspark.llm.token_counts import op10_token_counts
from flowspark.llm.toxicity import op3_toxicity
from flowspark.llm.unit_dedup import OP5_SQL, op5_unit_dedup
from flowspark.llm.whitening import op11_whitening

QUERIES = {
    "op1_packing": (op1_packing, None),
    "op2_decontaminate": (op2_decontaminate, None),
    "op3_toxicity": (op3_toxicity, None),
    "op4_suffix_dedup": (op4_suffix_dedup, None),
    "op5_unit_dedup": (op5_unit_dedup, OP5_SQL),
    "op6_jaccard_join": (op6_jaccard_join, None),
    "op7_nearest": (op7_nearest, None),
    "op8_licenses": (op8_licenses, None),
    "op9_line_dedup": (op9_line_dedup, None),
    "op10_token_counts": (op10_token_counts, None),
    "op11_whitening": (op11_whitening, None),
    "op12_fill_in_middle": (op12_fill_in_middle, OP12_SQL),
    "op13_language": (op13_language, None),
}
