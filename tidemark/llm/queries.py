"""The numbered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm.alignment import op11_alignment
from tidemark.llm.chat import op2_chat_formatting
from tidemark.llm.clusters import lloyd_sql, op13_centroid_clustering
from tidemark.llm.decontaminate import op7_decontamination
from tidemark.llm.extract import op12_html_extraction
from tidemark.llm.language import op9_language_id
from tidemark.llm.ngram_join import op4_ngram_jaccard_join
from tidemark.llm.pieces import op10_sentencepiece
from tidemark.llm.pii import op3_pii
from tidemark.llm.quality import op5_quality_rules
from tidemark.llm.sstable import op8_token_id_output
from tidemark.llm.substrings import op6_substring_dedup
from tidemark.llm.url_filters import op1_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_chat_formatting, op3_pii, op4_ngram_jaccard_join, op5_quality_rules, op6_substring_dedup,
        op7_decontamination, op8_token_id_output, op9_language_id, op10_sentencepiece,
        op11_alignment, op12_html_extraction, op13_centroid_clustering,
    )
}

SQL: dict[str, str] = {
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i AS s, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT g, min(doc_id) AS m FROM wins GROUP BY g),
gone AS (SELECT DISTINCT doc_id, s + k AS p FROM wins JOIN firsts USING (g) CROSS JOIN (SELECT unnest(range(13)) AS k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op13_centroid_clustering": lloyd_sql(),
}
