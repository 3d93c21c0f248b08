"""SQL twins of the queries of this subpackage, over whole tables."""

from __future__ import annotations

from wordloom.llm import mixing, phrases, quality, warc

SPACE = r"[\x20\x09-\x0D]"
WORDS = r"[^\x20\x09-\x0D]+"
FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '{WORDS}') AS ws FROM documents),
  sh AS (SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS s FROM w WHERE len(ws) >= 2
    UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1)),
  n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
  both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
  c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""


def _op3() -> str:
    dims = ", ".join(f"'{w}'" for w in quality.DIMENSIONS)
    marks = r"[.,;:!?''\"()\-]"
    gone = lambda pattern: f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))"
    kinds = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": SPACE, "mark": marks, "wide": r"[^\x00-\x7F]"}
    classes = ", ".join(f"{gone(p)} AS c_{k}" for k, p in kinds.items())
    listed = " UNION ALL ".join(f"SELECT doc_id, lang, 'class' AS what, '{k}' AS dim, c_{k} AS n FROM d" for k in (*kinds, "symbol"))
    return f"""WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
  l AS (SELECT doc_id, lang, text, regexp_extract_all(text, '{WORDS}') AS ws FROM docs),
  lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{WORDS}') GROUP BY doc_id),
  win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM l WHERE len(ws) >= 8)),
  dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS k FROM win) WHERE k > 1),
  rep AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM (SELECT doc_id, i, unnest(range(8)) AS o FROM dup) GROUP BY doc_id),
  c AS (SELECT *, len(ws) AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g')) AS word_chars, {gone('[#*$%&|<>]')} AS n_symbols, {classes} FROM l),
  d AS (SELECT c.*, length(text) - c_lower - c_upper - c_digit - c_space - c_mark - c_wide AS c_symbol, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
          n_words < {quality.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {quality.REPEAT_PERCENT} * n_words AS base_failed
        FROM c LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
  word AS (SELECT doc_id, lang, {FOLD.format('w')} AS w FROM (SELECT doc_id, lang, CASE WHEN regexp_matches(w, '{marks}$') THEN w[:-2] ELSE w END AS w FROM (SELECT doc_id, lang, unnest(ws) AS w FROM l))),
  cell AS (SELECT doc_id, lang, 'word' AS what, CASE WHEN w IN ({dims}) THEN w ELSE '(other)' END AS dim, count(*) AS n FROM word GROUP BY ALL UNION ALL {listed}),
  share AS (SELECT doc_id, lang, what, dim, n / sum(n) OVER (PARTITION BY doc_id, what) AS p FROM cell WHERE n > 0),
  ref AS (SELECT cell.lang, what, dim, sum(n) / sum(sum(n)) OVER (PARTITION BY cell.lang, what) AS q FROM cell JOIN d USING (doc_id) WHERE NOT base_failed AND n_words >= {quality.GUARD_WORDS} GROUP BY cell.lang, what, dim),
  js AS (SELECT doc_id, share.what, sum(p * log2(2 * p / (p + coalesce(q, 0))) / 2 + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) / 2 ELSE 0 END) + (1 - sum(coalesce(q, 0))) / 2 AS j, max(q) IS NOT NULL AS known
         FROM share LEFT JOIN ref ON share.lang IS NOT DISTINCT FROM ref.lang AND share.what = ref.what AND share.dim = ref.dim GROUP BY doc_id, share.what),
  verdict AS (SELECT doc_id, max(CASE WHEN what = 'class' AND known THEN j END) AS cj, max(CASE WHEN what = 'word' AND known THEN j END) AS wj FROM js GROUP BY doc_id)
  SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (n_words >= {quality.GUARD_WORDS} AND coalesce(sqrt(greatest(cj, 0)) > {quality.MAX_CLASS_DISTANCE} OR sqrt(greatest(wj, 0)) > {quality.MAX_WORD_DISTANCE} + {quality.WORD_CHANCE} / sqrt(n_words), false)) AS kept
  FROM d LEFT JOIN verdict USING (doc_id)"""


def _bucket(n: int | str, *parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12) AS BIGINT) % {n}"


def _op4(altered: int, lost: int) -> str:
    rn = "chr(13) || chr(10)"
    text = (
        f"'WARC/1.1' || {rn} || 'WARC-Type: resource' || {rn} || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || {rn} || 'WARC-Target-URI: ' || coalesce(url, '')"
        f" || {rn} || 'WARC-Block-Digest: sha256:' || sha256(coalesce(html, '')) || {rn} || 'Content-Type: text/html' || {rn} || 'Content-Length: ' || strlen(coalesce(html, '')) || {rn} || {rn} || coalesce(html, '') || {rn} || {rn}"
    )
    page = ("coalesce(CAST(page_id AS VARCHAR), '')", "url")
    return f"""WITH r AS (SELECT page_id, coalesce(url, '') AS url, {text} AS record FROM pages),
  h AS (SELECT *, strlen(record) AS length, sha256(record) AS digest, {_bucket(f'(SELECT greatest(1, CAST(ceil(count(*) / {warc.RECORDS_PER_FILE}.0) AS BIGINT)) FROM pages)', *page)} AS file_id FROM r),
  a AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file_id ORDER BY page_id, url, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
          {_bucket(lost, "'replica-lost'", *page)} = 0 AS lost, {_bucket(altered, "'replica-altered'", *page)} = 0 AS spoiled FROM h)
  SELECT file_id, "offset", CASE WHEN lost THEN 'missing' ELSE 'altered' END AS status, CAST(1 AS BIGINT) AS n, length, digest,
    CAST(CASE WHEN lost THEN 0 ELSE 1 END AS BIGINT) AS other_n, CASE WHEN lost THEN 0 ELSE length END AS other_length, CASE WHEN lost THEN '' ELSE sha256(substr(record, 1, length(record) - 1) || '?') END AS other_digest
  FROM a WHERE lost OR spoiled"""


OP5 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  pages AS (SELECT doc_id, k, length(h) // 2 AS n, substr(h, CAST(k * 400 + 1 AS INT), 498) AS h FROM (SELECT doc_id, h, unnest(range((length(h) // 2 + 199) // 200)) AS k FROM d)),
  b AS (SELECT doc_id, k, n, h, unnest(range(least(200, n - k * 200))) AS o FROM pages),
  x AS (SELECT doc_id, k * 200 + o AS p, substr(h, CAST(2 * o + 1 AS INT), 2) AS byte, CASE WHEN k * 200 + o + 50 <= n THEN substr(h, CAST(2 * o + 1 AS INT), 100) END AS win FROM b),
  first AS (SELECT win, min(doc_id) AS least FROM x WHERE win IS NOT NULL GROUP BY win),
  y AS (SELECT doc_id, p, byte, coalesce(max(CASE WHEN least < doc_id THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) >= p - 49, false) AS gone FROM x LEFT JOIN first USING (win)),
  z AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM y),
  g AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM z GROUP BY doc_id)
  SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents LEFT JOIN g USING (doc_id)"""

OP6 = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
  e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before, length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (2 * length(text) - length(replace(text, '<', '')) - length(replace(text, '>', ''))) AS n,
          length(role) + 4 * (length(role) - length(replace(role, '&', ''))) + 3 * (2 * length(role) - length(replace(role, '<', '')) - length(replace(role, '>', ''))) AS r FROM t),
  g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
          CAST(21 + sum(n + CASE WHEN before IS NULL THEN 8 + r WHEN before = role THEN 6 ELSE 16 + r END) AS BIGINT) AS formatted_chars, count(*) FILTER (before IS NULL OR before <> role) AS n_blocks FROM e GROUP BY conv_id)
  SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, n_blocks FROM g"""


def _op7(weights: dict[str, float], seed: int = 7) -> str:
    weight = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1.0 END"
    return f"""WITH RECURSIVE s AS (SELECT source, count(*) AS n, CAST({weight} AS DOUBLE) AS w FROM documents GROUP BY source),
  r AS (SELECT source, CAST((SELECT sum(n) FROM s) AS DOUBLE) / (SELECT sum(w) FROM s) * w / n AS rate FROM s),
  m AS (SELECT source, greatest(CAST(ceil(rate / {mixing.PART_MEAN}) AS INT), 1) AS parts, rate / greatest(CAST(ceil(rate / {mixing.PART_MEAN}) AS INT), 1) AS mean FROM r),
  cdf AS (SELECT source, 0 AS k, mean, exp(-mean) AS term, exp(-mean) AS total FROM m UNION ALL SELECT source, k + 1, mean, term * mean / (k + 1), total + term * mean / (k + 1) FROM cdf WHERE k < {mixing.TERMS - 1}),
  u AS (SELECT doc_id, documents.source, lang, n_chars, text, unnest(range(1, parts + 1)) AS j FROM documents JOIN m ON documents.source IS NOT DISTINCT FROM m.source),
  v AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', '{seed}', CAST(doc_id AS VARCHAR), md5(text), CAST(j AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0 AS x FROM u),
  k AS (SELECT doc_id, v.source, lang, n_chars, text, j, count(cdf.k) AS copies FROM v LEFT JOIN cdf ON cdf.source IS NOT DISTINCT FROM v.source AND total <= x GROUP BY ALL),
  c AS (SELECT doc_id, source, lang, n_chars, text, CAST(sum(copies) AS BIGINT) AS copies FROM k GROUP BY ALL)
  SELECT doc_id, unnest(range(copies)) AS copy_id, source, lang, n_chars, text FROM c"""


OP12 = rf"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({FOLD.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
  g AS (SELECT lang, ws[i:i + m - 1] AS g FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, (SELECT unnest(range(1, {phrases.LONGEST + 1})) AS m))),
  f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY ALL),
  n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
  c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= {phrases.LEAST}),
  cuts AS (SELECT c.lang, c.g, a, k, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * a) // (CAST(l.f AS HUGEINT) + r.f) AS score
    FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:len(c.g)]),
  best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
  inside AS (SELECT lang, s AS g, max(a) AS longer FROM (SELECT lang, a, g[i:i + m - 1] AS s FROM (SELECT *, unnest(range(1, len(g) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(g))) AS m FROM c))) GROUP BY ALL),
  kept AS (SELECT best.*, array_to_string(best.g, ' ') AS phrase FROM best LEFT JOIN inside USING (lang, g) WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST({phrases.PERCENT} AS HUGEINT) * a),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
  SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= {phrases.TOP}"""


def oracles(mix_weights: dict[str, float], altered: int, lost: int) -> dict[str, str]:
    return {
        "op1_minhash_odd_sketch": OP1,
        "op3_quality_divergence": _op3(),
        "op4_warc_fixity": _op4(altered, lost),
        "op5_suffix_radix": OP5,
        "op6_chat_format": OP6,
        "op7_mix_poisson": _op7(mix_weights),
        "op12_phrase_pivots": OP12,
    }
