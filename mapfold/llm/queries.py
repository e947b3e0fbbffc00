"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mapfold.llm.bpe import op10_merge_automaton
from mapfold.llm.decontaminate import op7_pigeonhole_edits
from mapfold.llm.language_model import op5_maxent_model
from mapfold.llm.licenses import op1_prefix_filter_join
from mapfold.llm.near_dup import op2_tensored_minhash
from mapfold.llm.oracle import BYTES, NEAR, NEGATIVES, PERIODS, SIMILAR, WORDS, license_sql, quality_sql
from mapfold.llm.periodic import op11_octave_tiles
from mapfold.llm.quality import op6_language_divergence
from mapfold.llm.set_join import op13_partition_signatures
from mapfold.llm.secrets import op8_secret_automaton
from mapfold.llm.sharding import op9_sampled_splitters
from mapfold.llm.substring_dup import op4_seed_extend
from mapfold.llm.suffix_dup import op3_run_length_index
from mapfold.llm.threshold_join import op12_suffix_norm_negatives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_prefix_filter_join,
        op2_tensored_minhash,
        op3_run_length_index,
        op4_seed_extend,
        op5_maxent_model,
        op6_language_divergence,
        op7_pigeonhole_edits,
        op8_secret_automaton,
        op9_sampled_splitters,
        op10_merge_automaton,
        op11_octave_tiles,
        op12_suffix_norm_negatives,
        op13_partition_signatures,
    )
}

ORACLE: dict[str, str] = {
    "op1_prefix_filter_join": license_sql(),
    "op2_tensored_minhash": NEAR,
    "op11_octave_tiles": PERIODS,
    "op12_suffix_norm_negatives": NEGATIVES,
    "op13_partition_signatures": SIMILAR,
    "op3_run_length_index": BYTES,
    "op4_seed_extend": WORDS,
    "op6_language_divergence": quality_sql(),
    "op9_sampled_splitters": """
WITH RECURSIVE bits AS (
  SELECT n, 0 AS k, CAST(n AS UINTEGER) AS c FROM range(256) t(n)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UINTEGER)) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8
), rows AS (
  SELECT doc_id, text, strlen(coalesce(text, '')) + 16 AS size, substr(md5(coalesce(text, '')), 1, 16) AS h FROM documents
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS start,
         row_number() OVER (ORDER BY h, doc_id) - 1 AS row, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY h) AS group_bytes
  FROM rows
), grouped AS (
  SELECT *, min(start) OVER (PARTITION BY h) AS group_start FROM placed
), sharded AS (
  SELECT *, least(39, CAST((CASE WHEN group_bytes * 4000 <= total THEN group_start ELSE start END) * 40 // total AS INTEGER)) AS shard FROM grouped
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(CAST(4294967295 AS UINTEGER), list_reduce(
         list_prepend(CAST(4294967295 AS UINTEGER), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS UINTEGER))),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(row - min(row) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sharded, crc
""",
}
