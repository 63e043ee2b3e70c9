"""DuckDB SQL of the registered operator queries, where SQL can express them."""

from __future__ import annotations

from clickwise.llm import license_scan as lic, line_dedup as ld
from clickwise.llm.common import UPPER

LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

EXACT_DEDUP = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {LOWERED} AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)
"""


def license_scan() -> str:
    rows = []
    for base, phrases in ((True, lic.BASE_PHRASES.items()), (False, ((t, n) for n, t in lic.TEMPLATES.items()))):
        for text, label in phrases:
            w = text.split()
            rows += [f"('{text}', '{label}', {base}, {q}, '{w[q]}', '{w[q + 1]}', {len(w) - 1})" for q in range(len(w) - 1)]
    return f"""
WITH tmpl(template, label, is_base, q, t0, t1, n_grams) AS (VALUES {', '.join(rows)}),
docs AS (SELECT row_number() OVER () AS rid, doc_id,
                list_filter(regexp_split_to_array({LOWERED}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT rid, unnest(range(0, len(w) - 1)) AS p, w FROM docs),
hits AS (SELECT DISTINCT rid, template, label, is_base, n_grams, q, p, p - q AS diag
         FROM grams JOIN tmpl ON w[p + 1] = t0 AND w[p + 2] = t1),
diags AS (SELECT rid, template, label, is_base, n_grams, diag, list(DISTINCT q) AS qs, min(p) AS lo, max(p) AS hi
          FROM hits GROUP BY ALL),
marked AS (SELECT *, CASE WHEN NOT is_base AND diag - lag(diag) OVER (PARTITION BY rid, template ORDER BY diag) <= {lic.BAND}
                          THEN 0 ELSE 1 END AS fresh FROM diags),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diag) AS run FROM marked),
runs AS (SELECT rid, template, label, is_base, n_grams, run, len(list_distinct(flatten(list(qs)))) AS votes,
                min(diag) AS start, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY ALL),
spans AS (SELECT *, votes / n_grams AS cover FROM runs
          WHERE CASE WHEN is_base THEN votes = n_grams
                ELSE votes / n_grams >= {lic.MIN_COVER} AND hi - lo < {lic.MAX_STRETCH} * n_grams END)
SELECT doc_id, any_value(len(w))::BIGINT AS n_words, count(*) FILTER (is_base) AS n_base,
       (min(start) FILTER (is_base))::BIGINT AS first_word, (max(start) FILTER (is_base))::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (is_base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels,
       round(coalesce(max(cover), 0.0)::DOUBLE, 6) AS score
FROM docs LEFT JOIN spans USING (rid) GROUP BY rid, doc_id
"""


def _mixed(docs: str, cycle: int = 1000, block_rows: int = 32) -> str:
    """CTEs up to ``mixed`` over the relation ``docs`` (doc_id, source): weights are the square root of
    the rows, in whole shares of 1,000 slots (for up to 500 sources); the sources' lags are stepped slot by slot."""
    return f"""
mix_rows AS (SELECT doc_id, coalesce(source, '') AS source,
                    row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST) - 1 AS rank
             FROM {docs}),
wants AS (SELECT source, sqrt(count(*)) AS want FROM mix_rows GROUP BY source),
small AS (SELECT *, want * {cycle} < sum(want) OVER () AS few FROM wants),
exacts AS (SELECT source, CASE WHEN few THEN 1.0 ELSE round(want * ({cycle} - count(*) FILTER (few) OVER ()) / sum(want) FILTER (NOT few) OVER (), 6) END AS exact FROM small),
floors AS (SELECT source, greatest(floor(exact), 1) AS whole, row_number() OVER (ORDER BY exact - floor(exact) DESC, source) AS ord FROM exacts),
shares AS (SELECT source, (whole + CASE WHEN ord <= {cycle} - sum(whole) OVER () THEN 1 ELSE 0 END)::BIGINT AS share FROM floors),
srcs AS (SELECT list(source ORDER BY source) AS names, list(share ORDER BY source) AS a FROM shares),
sched(t, done, pick) AS (
  SELECT -1, list_transform(a, lambda x: 0::BIGINT), 0::BIGINT FROM srcs
  UNION ALL
  SELECT t, list_transform(range(1, len(done) + 1), lambda i: done[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick
  FROM (SELECT s.t + 1 AS t, s.done,
               list_min(list_transform(list_filter(range(1, len(a) + 1),
                   lambda i: s.done[i] < a[i] AND (s.done[i] * {cycle}) // a[i] <= s.t + 1),
                   lambda i: ((s.done[i] + 1) * {cycle} + a[i] - 1) // a[i] * 1000000 + i)) % 1000000 AS pick
        FROM sched s, srcs WHERE s.t + 1 < {cycle})),
plan AS (SELECT names[pick] AS source, a[pick] AS share, t AS slot,
                row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM sched, srcs WHERE t >= 0),
mixed AS (SELECT r.doc_id, r.source, r.rank // {block_rows} AS block,
                 (r.rank // {block_rows}) // p.share * {cycle} + p.slot AS slot,
                 (r.rank % {block_rows})::INTEGER AS place, p.share
          FROM mix_rows r JOIN shares s USING (source) JOIN plan p ON p.source = r.source AND p.k = (r.rank // {block_rows}) % s.share)"""


def mixing() -> str:
    return f"WITH RECURSIVE {_mixed('documents')} SELECT doc_id, source, block, slot, place, share FROM mixed"


def _level(k: int) -> str:
    """CTEs of level ``k``: its runs of 16, each node's siblings, and the nodes above (one node stays as it is)."""
    return f"""
run{k} AS (SELECT grp, i // 16 AS up, any_value(n) AS n, list(node ORDER BY i) AS nodes FROM lv{k} GROUP BY grp, i // 16),
sib{k} AS (SELECT l.grp, l.i, CASE WHEN l.n = 1 THEN '' ELSE array_to_string(r.nodes[:l.i % 16], '') END AS lhs,
                  CASE WHEN l.n = 1 THEN '' ELSE array_to_string(r.nodes[l.i % 16 + 2:], '') END AS rhs, l.n = 1 AS top
           FROM lv{k} l JOIN run{k} r ON r.grp = l.grp AND r.up = l.i // 16),
lv{k + 1} AS (SELECT grp, up AS i, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node FROM run{k})"""


def merkle(levels: int = 5) -> str:
    """The whole tree level by level: ``levels`` of them (16 ** levels leaves) in a source, then as many over the sources."""
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v}))::VARCHAR || ':' || {v}, '-')" for v in
                                       ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"

    def crc(text: str) -> str:
        step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
        byte = f"list_reduce(list_prepend(xor(h, b), range(8)), lambda c, e: {step})"
        return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda h, b: {byte}), 4294967295)"
    over = range(levels, 2 * levels)
    way = [("d.grp", "d.i", k) for k in range(levels)] + [("''", "s.i", k) for k in over]
    joins = "\n".join(f"JOIN sib{k} s{k} ON s{k}.grp = {g} AND s{k}.i = {i} // {16 ** (k % levels)}" for g, i, k in way)
    siblings = " || ".join(f"s{k}.lhs || s{k}.rhs" for _, _, k in way)
    folds = ", ".join(f"f{k} AS (SELECT *, CASE WHEN top{k} THEN g{k} ELSE sha256(l{k} || g{k} || r{k}) END AS g{k + 1} FROM {f'f{k - 1}' if k else 'paths'})" for k in range(2 * levels))
    return f"""
WITH leaves AS (SELECT doc_id, source, coalesce('=' || source, '-') AS grp, {leaf('text')} AS leaf,
                       CASE WHEN {crc('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} END AS tampered FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
lv0 AS (SELECT grp, i, n, leaf AS node FROM d),{",".join(_level(k) for k in range(levels))},
s AS (SELECT grp, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM lv{levels}),
lv{levels}s AS (SELECT '' AS grp, i, n, subroot AS node FROM s),{",".join(_level(k) for k in over).replace(f"FROM lv{levels} ", f"FROM lv{levels}s ")},
paths AS (SELECT d.doc_id, d.source, d.leaf, s.subroot, t.node AS root, sha256({siblings}) AS proof_sha256, coalesce(d.tampered, d.leaf) AS g0,
                 {", ".join(f"s{k}.lhs AS l{k}, s{k}.rhs AS r{k}, s{k}.top AS top{k}" for _, _, k in way)}
          FROM d JOIN s ON s.grp = d.grp CROSS JOIN lv{2 * levels} t
          {joins}),
{folds}
SELECT doc_id, source, leaf, subroot, root, proof_sha256, g{2 * levels} AS folded_root, g{2 * levels} = root AS verified FROM f{2 * levels - 1}"""


LEXICAL_SEARCH = f"""
WITH terms AS (SELECT doc_id, rid, unnest(regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
               FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
tfs AS (SELECT rid, any_value(doc_id) AS doc_id, term, count(*)::BIGINT AS tf FROM terms GROUP BY rid, term),
lens AS (SELECT rid, sum(tf)::BIGINT AS n FROM tfs GROUP BY rid),
corpus AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM lens),
dfs AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, corpus GROUP BY term),
imp AS (SELECT t.doc_id, t.rid, t.term, d.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))) AS v
        FROM tfs t JOIN lens USING (rid) JOIN dfs d USING (term), corpus),
items AS (SELECT iid, any_value(item_id) AS item_id, term, count(*) AS times
          FROM (SELECT item_id, iid, unnest(regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
                FROM (SELECT *, row_number() OVER () AS iid FROM benchmark)) GROUP BY iid, term),
scores AS (SELECT iid, any_value(item_id) AS item_id, rid, any_value(doc_id) AS doc_id, sum(times * v)::BIGINT AS score
           FROM items JOIN imp USING (term) GROUP BY iid, rid)
SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW best AS (PARTITION BY iid ORDER BY score DESC, doc_id NULLS FIRST) QUALIFY row_number() OVER best <= 10
"""


def line_dedup() -> str:
    """Matches by the words themselves: the lists without one word."""
    return f"""
WITH lines AS (SELECT doc_id, unnest(range(0, len(a))) AS line_no, a FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
l AS (SELECT doc_id, line_no, a[line_no + 1] AS line, string_split(a[line_no + 1], ' ') AS w FROM lines),
firsts AS (SELECT line, any_value(w) AS w, min({{'d': doc_id, 'l': line_no}}) AS first FROM l WHERE len(w) >= {ld.MIN_WORDS} GROUP BY line),
longer AS (SELECT line, first, w, unnest(range(0, len(w))) AS i FROM firsts WHERE len(w) >= {ld.NEAR_WORDS}),
cut AS (SELECT line, first, i, len(w) AS n, array_to_string(w[:i] || w[i + 2:], ' ') AS rest FROM longer),
replaced AS (SELECT line FROM (SELECT line, first, min(first) OVER (PARTITION BY rest, i, n) AS best FROM cut) WHERE best < first),
inserted AS (SELECT c.line AS long_line, c.first AS long_first, f.line AS short_line, f.first AS short_first
             FROM cut c JOIN firsts f ON f.line = c.rest WHERE len(f.w) >= {ld.NEAR_WORDS}),
near AS (SELECT line FROM replaced UNION SELECT CASE WHEN long_first < short_first THEN short_line ELSE long_line END FROM inserted),
judged AS (SELECT l.doc_id, l.line_no, f.line IS NOT NULL AND (n.line IS NOT NULL OR f.first <> {{'d': l.doc_id, 'l': l.line_no}}) AS gone
           FROM l LEFT JOIN firsts f USING (line) LEFT JOIN near n USING (line))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       coalesce(string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (gone), '') AS dropped_lines
FROM judged GROUP BY doc_id"""
