"""SQL of the operators' queries: name -> text for DuckDB."""

from fleetmeter.llm import license_scan, line_dedup, quality_rules
from fleetmeter.llm.url_filters import HOST_RULES, OWN_BLOCKED

_LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(column):
    return f"regexp_extract_all({_LOWERED.format(f"coalesce({column}, '')")}, '{_WORD}')"


def _listed(words):
    return "[" + ", ".join(f"'{word}'" for word in words) + "]"


def _license_sql():
    """Every start of every template whose key phrases stand in their places."""
    found = []
    for template in license_scan.templates():
        tests = " AND ".join(
            f"w[s + {offset + 1}:s + {offset + len(part)}] = {_listed(part)}"
            for offset, part in template.phrases
        )
        size = len(template.words)
        same = " + ".join(
            f"CASE WHEN w[s + {i + 1}] = '{word}' THEN 1 ELSE 0 END" for i, word in enumerate(template.words)
        )
        found.append(
            f"list_transform(list_filter(CASE WHEN contains(joined, ' {' '.join(template.phrases[0][1])} ') "
            f"THEN range(0, len(w)) ELSE [] END, lambda s: {tests}), lambda s: "
            f"{{'label': '{template.label}', 'base': {str(template.base).lower()}, 'start': s, "
            f"'score': ({same}) / {size}.0::DOUBLE}})"
        )
    return f"""
WITH words AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS joined
               FROM (SELECT doc_id, {_words("text")} AS w FROM documents)),
matched AS (SELECT doc_id, len(w) AS n, flatten([{", ".join(found)}]) AS m FROM words),
parted AS (SELECT *, list_filter(m, lambda x: x.base) AS b FROM matched)
SELECT doc_id, n::BIGINT AS n_words, len(b)::BIGINT AS n_base,
       list_min(list_transform(b, lambda x: x.start))::BIGINT AS first_word,
       list_max(list_transform(b, lambda x: x.start))::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(b, lambda x: x.label))), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(m, lambda x: x.label))), ','), '') AS labels,
       coalesce(list_max(list_transform(m, lambda x: x.score)), 0.0)::DOUBLE AS score
FROM parted
"""


_DECONTAMINATION = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text")} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, w[i:i + 9] AS win
            FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS size FROM windows),
places AS (SELECT r, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size),
hits AS (SELECT DISTINCT p.r, p.i, p.size, v.item
         FROM (SELECT places.r, i, size, w[i:i + size - 1] AS win FROM places JOIN docs USING (r)) p
         JOIN windows v ON p.win = v.win),
hit_words AS (SELECT r, count(DISTINCT k) AS n_hit
              FROM (SELECT r, unnest(range(i, i + size)) AS k FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
              FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

_LINE_DEDUP = rf"""
WITH lines AS (
  SELECT doc_id, text, line, regexp_extract_all(content, '.*?[.!?] |.+$') AS sentences, content
  FROM (SELECT doc_id, text, unnest(range(0, len(parts))) AS line, unnest(parts) AS content
        FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
closed AS (  -- a sentence end at the end of a line opens an empty sentence there
  SELECT * EXCLUDE (sentences),
         CASE WHEN content = '' THEN [''] WHEN regexp_matches(content, '[.!?] $') THEN list_append(sentences, '')
              ELSE sentences END AS sentences FROM lines),
ends AS (SELECT doc_id, max(line) AS last_line FROM closed GROUP BY doc_id),
written AS (
  SELECT doc_id, line, 0 AS part, content AS unit FROM closed
  UNION ALL
  SELECT doc_id, line, unnest(range(1, len(sentences) + 1)), unnest(sentences) FROM closed WHERE len(sentences) > 1),
counted AS (SELECT doc_id, line, part, unit, len(string_split(unit, ' ')) AS tokens
            FROM (SELECT * REPLACE (trim(unit, ' ') AS unit) FROM written)),
masked AS (SELECT *, regexp_replace(unit, '[^\s0-9]*[0-9]\S*', '{line_dedup.FIELD}', 'g') AS masked FROM counted
           WHERE tokens >= CASE WHEN part = 0 THEN {line_dedup.LINE_TOKENS} ELSE {line_dedup.SENTENCE_TOKENS} END),
placed AS (
  SELECT *, CASE WHEN fixed >= {line_dedup.FIXED_TOKENS} AND 2 * fixed > tokens THEN masked ELSE unit END AS template
  FROM (SELECT *, len(regexp_extract_all(masked, '\p{{L}}\S*')) AS fixed FROM masked)),
parted AS (
  SELECT doc_id, line, part, template, tokens, string_split(template, ' ') AS w,
         CAST(ceil((tokens - {line_dedup.LEADING_TOKENS}) / {line_dedup.STRETCHES}.0) AS BIGINT) AS size FROM placed),
units AS (
  SELECT doc_id, line, part, template, (tokens, w[1:{line_dedup.LEADING_TOKENS}]) AS leaf,
         CASE WHEN tokens BETWEEN {line_dedup.MERGED[0]} AND {line_dedup.MERGED[1]} THEN
           list_transform(range(0, {line_dedup.STRETCHES}), lambda k:
             w[{line_dedup.LEADING_TOKENS} + k * size + 1:{line_dedup.LEADING_TOKENS} + (k + 1) * size]) END AS stretches
  FROM parted),
templates AS (SELECT leaf, template, any_value(stretches) AS stretches, min(doc_id) AS first_doc, max(doc_id) AS last_doc
              FROM units GROUP BY leaf, template),
fields AS (  -- a template once for each field it may have
  SELECT leaf, template, first_doc, field, list_concat(stretches[1:field], stretches[field + 2:]) AS others
  FROM (SELECT *, unnest(range(0, {line_dedup.STRETCHES})) AS field FROM templates WHERE stretches IS NOT NULL)),
alike AS (SELECT leaf, field, others, min(first_doc) AS merged FROM fields GROUP BY ALL HAVING count(*) > 1),
keepers AS (
  SELECT t.leaf, t.template, least(t.first_doc, min(a.merged)) AS keeper, t.last_doc
  FROM templates t LEFT JOIN (SELECT leaf, template, merged FROM fields JOIN alike USING (leaf, field, others)) a
    ON t.leaf = a.leaf AND t.template = a.template GROUP BY t.leaf, t.template, t.first_doc, t.last_doc),
dropped AS (SELECT doc_id, line, part FROM units JOIN keepers USING (leaf, template) WHERE keeper <> last_doc AND doc_id <> keeper),
sentences AS (
  SELECT doc_id, line, unnest(range(1, len(sentences) + 1)) AS part, unnest(sentences) AS unit,
         len(sentences) AS n FROM closed),
marked AS (
  SELECT s.*, line < last_line AND part = n AS breaks,
         EXISTS (SELECT 1 FROM dropped d WHERE d.doc_id = s.doc_id AND d.line = s.line
                 AND (d.part = 0 OR d.part = s.part)) AS gone
  FROM sentences s JOIN ends USING (doc_id)),
texts AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(unit || CASE WHEN breaks THEN chr(10) ELSE '' END, '' ORDER BY line, part)
                  FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       length(kept)::BIGINT AS kept_chars, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN texts USING (doc_id)
"""


def _url_sql():
    ranked = sorted(HOST_RULES, key=lambda r: (-len(r[1]), r[1]))
    rules = []
    for verdict, rule in ranked:
        host, _, path = rule.partition("/")
        rules.append((
            f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", rule, verdict))
    chosen = " ".join(f"WHEN {test} THEN '{rule}'" for test, rule, _ in rules)
    verdicts = " ".join(f"WHEN '{rule}' THEN '{verdict}'" for _, rule, verdict in rules)
    own = " OR ".join(
        "regexp_full_match('.' || host || path, '(?s)" + glob.replace(".", "[.]").replace(
            "**", "@").replace("*", "[^/]*").replace("@", ".*") + "')" for glob in OWN_BLOCKED
    )
    lowered = _LOWERED.format("regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*')")
    return f"""
WITH hosts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN {lowered} ELSE '' END AS host,
         CASE WHEN strpos(url, '://') > 0 THEN
           regexp_extract(substr(url, strpos(url, '://') + 3), '(?s)^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
ruled AS (SELECT *, CASE {chosen} END AS rule FROM hosts)
SELECT page_id, host, path, rule,
       CASE rule {verdicts} ELSE CASE WHEN {own} THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled
"""


_NGRAM_JOIN = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) END AS own
  FROM words),
members AS (SELECT doc_id, len(own) AS size, unnest(own) AS shingle FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y
          FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id
          HAVING 100 * count(*) >= 80 * (any_value(a.size) + any_value(b.size) - count(*))),
reached AS (SELECT doc_id AS x, doc_id AS y FROM documents
            UNION SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x)
SELECT sets.doc_id, len(own)::BIGINT AS n_shingles, min(y) AS component_id
FROM sets JOIN reached ON sets.doc_id = reached.x GROUP BY sets.doc_id, own
"""


def _quality_rules_sql():
    """The counts word by word, the rules, and the hosts' shrunk rates."""
    r = quality_rules
    rules = {
        "few_words": f"n_words < {r.LEAST_WORDS}",
        "repeated_words": f"100 * n_repeat_words > {r.REPEATED_PERCENT} * n_words",
        "symbols": f"100 * n_symbols > {r.SYMBOL_PERCENT} * n_words",
        "duplicate_lines": f"100 * n_dup_lines > {r.DUPLICATE_LINES_PERCENT} * n_lines",
        "word_length": f"word_chars < {r.WORD_LENGTHS[0]} * n_words OR word_chars > {r.WORD_LENGTHS[1]} * n_words",
    }
    by_rule = " UNION ALL ".join(
        f"SELECT host, '{name}' AS rule, count(*) AS n, count(*) FILTER ({test}) AS f FROM counts GROUP BY host"
        for name, test in rules.items())
    solid = r"[^\x20\x09-\x0D]"
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '{solid}+') AS w FROM texts),
windows AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS win
            FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
twice AS (SELECT r, win FROM windows GROUP BY r, win HAVING count(*) > 1),
repeated AS (SELECT r, count(DISTINCT k) AS n_repeat_words
             FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM windows JOIN twice USING (r, win)) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts),
line_counts AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
                FROM lines WHERE regexp_matches(line, '{solid}') GROUP BY r),
counts AS (
  SELECT r, doc_id, host, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words LEFT JOIN repeated USING (r) LEFT JOIN line_counts USING (r)),
totals AS ({by_rule}),
sums AS (SELECT rule, count(*) AS hosts, sum(n)::DOUBLE AS n, sum(f)::DOUBLE AS f, sum(n::DOUBLE * n) AS nn,
                sum(f::DOUBLE * f / n) AS ff FROM totals GROUP BY rule),
shares AS (
  SELECT *, f / n AS mean, f / n * (1 - f / n) AS noise,
         (ff - f * f / n - f / n * (1 - f / n) * (hosts - 1))
         / nullif(f / n * (1 - f / n) * (n - nn / n - (hosts - 1)), 0) AS share FROM sums),
priors AS (SELECT rule, mean, greatest({r.LEAST_SPREAD}::DOUBLE, least({r.MOST_SPREAD}::DOUBLE, coalesce(share, 0))) AS share
           FROM shares),
verdicts AS (
  SELECT host, rule, ((1 - share) / share * mean + totals.f) / ((1 - share) / share + totals.n) > {r.HOST_RATE} AS rejected
  FROM totals JOIN priors USING (rule)),
rejected AS (SELECT host, string_agg(rule, ',' ORDER BY rule) AS by_rules FROM verdicts WHERE rejected GROUP BY host),
judged AS (SELECT *, {rules["few_words"]} OR {rules["repeated_words"]} AS base_failed FROM counts)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND by_rules IS NULL AS kept, coalesce(by_rules, '') AS host_rejected_by
FROM judged LEFT JOIN rejected ON judged.host IS NOT DISTINCT FROM rejected.host
"""


_RANKED = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents),
items AS (SELECT row_number() OVER () AS item, item_id, {_words("text")} AS w FROM benchmark),
sizes AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM docs),
postings AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM postings, sizes GROUP BY term, n_docs),
wanted AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(w) AS term FROM items) GROUP BY item, term),
products AS (
  SELECT r, term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(docs.w) * n_docs) // n_terms))) AS product
  FROM postings JOIN docs USING (r) JOIN weights w USING (term), sizes),
scores AS (SELECT item, r, sum(times * product) AS score FROM wanted JOIN products USING (term) GROUP BY item, r),
placed AS (SELECT item, item_id, doc_id, score,
                  row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS place
           FROM scores JOIN docs USING (r) JOIN items USING (item) WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score::BIGINT AS score FROM placed WHERE place <= 10
"""


_CRC32 = (
    "xor(4294967295::UBIGINT, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT), "
    "lambda crc, byte: list_reduce(list_transform(range(8), lambda i: i::UBIGINT), lambda r, i: "
    "CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END, xor(crc, byte)), 4294967295::UBIGINT))"
)


def _field(column):
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR, '-')"


def _leaf(n_chars):
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_MERKLE = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
         CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS leaf_now FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, leaf_now) - 1 AS i FROM rows),
trees AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY i) AS nodes FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda k: sha256(array_to_string(nodes[k + 1:k + 2], '')))
  FROM trees WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, level AS height,
                    row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM trees WHERE len(nodes) = 1),
forest AS (
  SELECT 0 AS level, list(subroot ORDER BY i) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda k: sha256(array_to_string(nodes[k + 1:k + 2], '')))
  FROM forest WHERE len(nodes) > 1),
top AS (SELECT nodes[1] AS root FROM forest WHERE len(nodes) = 1),
steps AS (  -- the sibling at each level on the way up, NULL where there is none
  SELECT l.lang, l.i, t.level, (l.i >> t.level) & 1 AS bit, t.nodes[xor(l.i >> t.level, 1) + 1] AS sibling
  FROM leaves l JOIN trees t ON l.lang IS NOT DISTINCT FROM t.lang WHERE len(t.nodes) > 1
  UNION ALL
  SELECT l.lang, l.i, s.height + f.level, (s.i >> f.level) & 1, f.nodes[xor(s.i >> f.level, 1) + 1]
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, forest f WHERE len(f.nodes) > 1),
proofs AS (
  SELECT lang, i, coalesce(string_agg(sibling, '' ORDER BY level), '') AS proof,
         list({{'bit': bit, 'sibling': sibling}} ORDER BY level) AS path FROM steps GROUP BY lang, i),
folds AS (
  SELECT l.lang, l.i, leaf_now AS digest, 0 AS done, coalesce(path, []) AS path
  FROM leaves l LEFT JOIN proofs p ON l.lang IS NOT DISTINCT FROM p.lang AND l.i = p.i
  UNION ALL
  SELECT lang, i, sha256(CASE WHEN path[done + 1].sibling IS NULL THEN digest
                              WHEN path[done + 1].bit = 1 THEN path[done + 1].sibling || digest
                              ELSE digest || path[done + 1].sibling END), done + 1, path
  FROM folds WHERE done < len(path))
SELECT l.doc_id, l.leaf, s.subroot, top.root, sha256(coalesce(p.proof, '')) AS proof_sha256,
       f.digest AS folded_root, f.digest = top.root AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
LEFT JOIN proofs p ON l.lang IS NOT DISTINCT FROM p.lang AND l.i = p.i
JOIN folds f ON l.lang IS NOT DISTINCT FROM f.lang AND l.i = f.i AND f.done = len(f.path), top
"""


ORACLE = {
    "op1_license_scan": _license_sql(),
    "op3_decontamination": _DECONTAMINATION,
    "op4_line_dedup": _LINE_DEDUP,
    "op6_url_filters": _url_sql(),
    "op8_ngram_join": _NGRAM_JOIN,
    "op11_quality_rules": _quality_rules_sql(),
    "op12_ranked_search": _RANKED,
    "op13_merkle_manifest": _MERKLE,
}
