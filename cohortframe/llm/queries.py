"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_alignment
from .conversation_repair import op11_conversation_repair
from .embedding_dedup import op4_embedding_dedup
from .language_id import op8_language_id
from .minhash_dedup import op10_minhash
from .mtree_search import op1_mtree_search
from .packing import op6_packing
from .piece_merges import op9_pieces
from .token_files import op5_token_files
from .suffix_dedup import op13_suffix_dedup
from .toxicity import op3_toxicity
from .url_filter import op2_url_filter
from .warc import op7_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mtree_search": op1_mtree_search,
        "op2_url_filter": op2_url_filter,
        "op3_toxicity": op3_toxicity,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_token_files": op5_token_files,
        "op6_packing": op6_packing,
        "op7_warc": op7_warc,
        "op8_language_id": op8_language_id,
        "op9_pieces": op9_pieces,
        "op10_minhash": op10_minhash,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_alignment": op12_alignment,
        "op13_suffix_dedup": op13_suffix_dedup,
    }


_FINITE = "vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_BASE32 = "list_aggregate(flatten(list_transform(range(8), lambda g: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * g + 1)::INT, 5))::BIGINT >> s) & 31)::INT + 1, 1)))), 'string_agg', '')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mtree_search": f"""
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                       WHERE {_FINITE}),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
                  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
            SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
            FROM s QUALIFY rank <= 5""",
        "op4_embedding_dedup": f"""
            WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
                WHERE label IS NOT NULL AND {_FINITE} AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
            l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
                  AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
            r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
            c AS (SELECT x, min(y) AS m FROM r GROUP BY x), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
            SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.m, vec_id) AS component_id, vec_id = coalesce(c.m, vec_id) AS kept
            FROM embeddings e LEFT JOIN c ON e.vec_id = c.x LEFT JOIN n ON e.vec_id = n.a""",
        "op10_minhash": r"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
            l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
            r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
            c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
            SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.m, d.doc_id) AS component_id, d.doc_id = coalesce(c.m, d.doc_id) AS kept
            FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id""",
        "op7_warc": f"""
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
            f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
            SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
                   CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> first_id THEN first_id END AS refers_to
            FROM p JOIN f USING (h)""",
    }
