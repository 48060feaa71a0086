"""Queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

import re

from .decontamination import op6_benchmark_decontamination
from .licenses import PHRASES, TEMPLATES, op3_license_scan
from .ngram_join import op9_ngram_jaccard_join
from .packing import op8_packing
from .quality import op10_quality_classifier
from .quotes import op4_quotation_linking
from .repeated_strings import PASSAGE, op5_suffix_array_dedup
from .repeated_windows import op2_substring_dedup
from .vector_links import op1_embedding_near_dedup
from .warc import op7_warc

QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op3_license_scan": op3_license_scan,
    "op4_quotation_linking": op4_quotation_linking,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
}

_SPACE = r"[\x20\x09-\x0D]+"

#: Smallest node reachable over links (a, b), for each node of a table nodes(id).
_REACH = """
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT reach.id, sides.b FROM reach JOIN sides ON sides.a = reach.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""



def _doubled_sql(most: int) -> str:
    """h1, h2, h4, ... up to `most`: a hash of as many bytes from each place on, each from two of the level before."""
    levels, k = ["h1 AS (SELECT doc_id, octet_length(b) AS n, unnest(range(1, octet_length(b) + 1)) AS i, unnest(regexp_extract_all(hex(b), '..')) AS h FROM d)"], 1
    while 2 * k <= most:
        levels.append(f"h{2 * k} AS (SELECT doc_id, n, i, hash(h, lead(h, {k}) OVER (PARTITION BY doc_id ORDER BY i)) AS h FROM h{k})")
        k *= 2
    return ", ".join(levels)


def _left_sql(name: str, length: int, whole: bool) -> str:
    """What is left of each document's bytes without strings of a length that start twice (with whole, of whole characters)."""
    k = 1 << (length.bit_length() - 1)
    inside = lambda at: f"(b[{at}:{at}] >= '\\x80'::BLOB AND b[{at}:{at}] < '\\xC0'::BLOB)"
    low = f"CASE WHEN NOT {inside('x')} THEN x WHEN NOT {inside('x - 1')} THEN x - 1 WHEN NOT {inside('x - 2')} THEN x - 2 ELSE x - 3 END" if whole else "x"
    high = f"CASE WHEN NOT {inside('y + 1')} THEN y WHEN NOT {inside('y + 2')} THEN y + 1 WHEN NOT {inside('y + 3')} THEN y + 2 ELSE y + 3 END" if whole else "y"
    return f"""
{name}_key AS (SELECT doc_id, n, i, hash(h, lead(h, {length - k}) OVER (PARTITION BY doc_id ORDER BY i)) AS h FROM h{k}),
{name}_two AS (SELECT h FROM {name}_key WHERE i <= n - {length - 1} GROUP BY h HAVING count(*) > 1),
{name}_at AS (SELECT doc_id, i, 2 AS n FROM {name}_key SEMI JOIN {name}_two USING (h) WHERE i <= n - {length - 1}),
{name}_new AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length}, true)::INTEGER AS new FROM {name}_at WHERE n > 1),
{name}_run AS (SELECT doc_id, min(i) AS x, max(i) + {length - 1} AS y FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM {name}_new) GROUP BY doc_id, g),
{name}_cut AS (SELECT doc_id, y - x + 1 AS n, {low} AS x, {high} AS y FROM {name}_run JOIN d USING (doc_id)),
{name}_piece AS (SELECT doc_id, x, n, b[coalesce(lag(y) OVER (PARTITION BY doc_id ORDER BY x), 0) + 1:x - 1] AS p, y FROM {name}_cut JOIN d USING (doc_id)),
{name} AS (SELECT doc_id, sum(n)::BIGINT AS n_removed, count(*) AS n_spans, unhex(string_agg(hex(p), '' ORDER BY x) || hex(any_value(b)[max(y) + 1:])) AS kept FROM {name}_piece JOIN d USING (doc_id) GROUP BY doc_id)"""


def _phrase_sql(phrase: str) -> str:
    return " AND ".join(f"{column} = '{word}'" for column, word in zip("abc", phrase.split(), strict=False))


def _template_regex(markup: str) -> str:
    """A template as a regular expression over words, each with a space before it; one space ends the text."""
    out, leading, depth = "", True, 0
    for part in re.split(r"(<<.*?>>)", markup):
        if part.startswith("<<"):
            depth += {"<<optional>>": 1, "<<end>>": -1}.get(part, 0)
            if not leading:
                out += {"<<optional>>": "(?:", "<<end>>": ")?"}.get(part) or f"(?: [^ ]+){{0,{part[5:-2].strip()}}}"
        elif part.strip() and not (leading and depth):
            leading = False
            out += "".join(f" {w}" for w in re.findall(r"[0-9a-z]+", part.lower()))
    return out + " "


ORACLE_SQL: dict[str, str] = {
    "op5_suffix_array_dedup": f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), {_doubled_sql(400)}, {_left_sql("s", 400, False)}, {_left_sql("p", PASSAGE, True)}
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(s.n_removed, 0)::BIGINT AS n_removed, coalesce(s.n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(s.kept, b)) AS kept_sha256, decode(coalesce(p.kept, b)) AS text FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id""",
    "op1_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
nodes AS (SELECT vec_id AS id FROM embeddings),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.9), {_REACH},
n AS (SELECT a AS id, count(*) AS n FROM sides GROUP BY a)
SELECT least.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, component_id = least.id AS kept FROM least LEFT JOIN n ON n.id = least.id""",
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM windows) WHERE rn > 1),
marked AS (SELECT words.doc_id, j, word, max((later.i IS NOT NULL)::INTEGER) OVER (PARTITION BY words.doc_id ORDER BY j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM words LEFT JOIN later ON later.doc_id = words.doc_id AND later.i = words.j),
kept AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (gone = 0), '') AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    # Without seeds: equal tokens of every overlay of an item over a document.
    "op6_benchmark_decontamination": """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, w, len(w) AS m, least(len(w), 20) AS width FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
tp AS (SELECT doc_id, unnest(range(0, len(w))) AS p, unnest(w) AS word FROM t),
ip AS (SELECT item_id, m, width, unnest(range(0, m)) AS q, unnest(w) AS word FROM i),
o AS (SELECT DISTINCT doc_id, item_id, m, width, p - q AS off, q FROM tp JOIN ip USING (word)),
e AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, off) AS matched FROM (SELECT o.* FROM o JOIN (SELECT doc_id, item_id, off FROM o GROUP BY ALL HAVING count(*) >= 0.8 * any_value(width)) USING (doc_id, item_id, off))),
b AS (SELECT doc_id, item_id, m, width, matched, count(*) OVER (PARTITION BY doc_id, item_id, off ORDER BY q RANGE BETWEEN CURRENT ROW AND width - 1 FOLLOWING) AS best FROM e)
SELECT doc_id, item_id, max(width)::INTEGER AS "window", max(best)::INTEGER AS overlap, max(matched)::INTEGER AS matched, max(m)::INTEGER AS item_tokens FROM b WHERE best >= 0.8 * width GROUP BY doc_id, item_id""",
    "op3_license_scan": f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c FROM d),
hits AS (SELECT doc_id, i, CASE {" ".join(f"WHEN {_phrase_sql(k)} THEN '{v}'" for k, v in PHRASES.items())} END AS label FROM words),
base AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, list_distinct(list(label)) AS labels FROM hits WHERE label IS NOT NULL GROUP BY doc_id),
line AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS t, len(w) AS n FROM d),
found AS (SELECT doc_id, n, list_filter([{", ".join(f"CASE WHEN regexp_matches(t, '{_template_regex(v)}') THEN '{k}' END" for k, v in TEMPLATES.items())}], lambda x: x IS NOT NULL) AS labels FROM line)
SELECT found.doc_id, found.n::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), found.labels))), ',') AS labels, CASE WHEN len(found.labels) > 0 THEN 1.0 WHEN base.n > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM found LEFT JOIN base ON base.doc_id = found.doc_id""",
    "op7_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON f.d = p.d""",
    "op9_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5) UNION SELECT doc_id, hash(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
nodes AS (SELECT doc_id AS id FROM documents),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM sh p JOIN sh q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)), {_REACH}
SELECT id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM least LEFT JOIN n ON n.doc_id = least.id""",
}
