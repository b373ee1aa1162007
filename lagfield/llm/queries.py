"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from . import collocations, licenses, topk
from .collocations import op11_collocations
from .gif import op4_gif_media
from .html_text import op1_main_text
from .jaccard import op13_similarity_join
from .langid import op9_compression_language
from .licenses import op5_license_scan
from .mixing import op2_block_mixing
from .packing import op10_vector_best_fit
from .periods import op12_periodic_runs
from .quality import op7_ordinal_quality
from .sharding import op6_minimax_sharding
from .simhash import op8_simhash
from .topk import op3_pivot_top_k

QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_block_mixing": op2_block_mixing,
    "op3_pivot_top_k": op3_pivot_top_k,
    "op4_gif_media": op4_gif_media,
    "op5_license_scan": op5_license_scan,
    "op6_minimax_sharding": op6_minimax_sharding,
    "op7_ordinal_quality": op7_ordinal_quality,
    "op8_simhash": op8_simhash,
    "op9_compression_language": op9_compression_language,
    "op10_vector_best_fit": op10_vector_best_fit,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_similarity_join": op13_similarity_join,
}

ORACLES: dict[str, str] = {
    "op3_pivot_top_k": topk.ORACLE,
    "op5_license_scan": licenses.ORACLE,
    "op11_collocations": collocations.ORACLE,
}
