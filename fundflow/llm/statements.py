"""SQL of the text queries that SQL can express, written from their definitions."""

from __future__ import annotations

# ---- op8: words of windows of 35 that stand twice -----------------------------

BLOCKS = """
  WITH w AS MATERIALIZED (
    SELECT doc_id, row_number() OVER () AS r,
           string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '^[\\x20\\x09-\\x0D]+', ''),
             '[\\x20\\x09-\\x0D]+$', ''), '[\\x20\\x09-\\x0D]+') AS words FROM documents),
  d AS (SELECT doc_id, r, CASE WHEN words = [''] THEN [] ELSE words END AS words FROM w),
  win AS (SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS h
          FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)),
  twice AS (SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
  gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM twice),
  kept AS (SELECT u.r, string_agg(u.word, ' ' ORDER BY u.i) AS text FROM (
             SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d) u
           ANTI JOIN gone g ON g.r = u.r AND g.i = u.i GROUP BY 1)
  SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed,
         sha256(coalesce(k.text, '')) AS kept_sha256
  FROM d LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY 1) g ON g.r = d.r
  LEFT JOIN kept k ON k.r = d.r"""

# ---- op6: bytes of stretches of 400 that stand twice ---------------------------

SUFFIXES = """
  WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
  win AS (SELECT r, i, md5(array_slice(t, i + 1, i + 400)) AS h
          FROM (SELECT r, t, unnest(range(0, octet_length(t) - 399)) AS i FROM d WHERE octet_length(t) >= 400)),
  twice AS (SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
  marked AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400, true) AS fresh FROM twice),
  runs AS (SELECT r, i, count(*) FILTER (fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
  spans AS (SELECT r, min(i) AS s, max(i) + 400 AS e FROM runs GROUP BY r, run),
  cuts AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a, s AS b FROM spans
           UNION ALL SELECT d.r, coalesce(max(e), 0), octet_length(any_value(t)) FROM d
           LEFT JOIN spans ON spans.r = d.r GROUP BY d.r),
  kept AS (SELECT c.r, string_agg(CASE WHEN b > a THEN hex(array_slice(t, a + 1, b)) ELSE '' END, ''
             ORDER BY a, b) AS x FROM cuts c JOIN d ON d.r = c.r GROUP BY 1)
  SELECT d.doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
         CAST(coalesce(g.k, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
  FROM d JOIN kept ON kept.r = d.r
  LEFT JOIN (SELECT r, sum(e - s) AS n, count(*) AS k FROM spans GROUP BY 1) g ON g.r = d.r"""

# ---- op13: ternary trees over leaves and over sources --------------------------


def _levels(name: str, first: str, most: int) -> list[str]:
    """Nodes of each level with what stands left and right of them in their run."""
    out = [f"{name}0 AS ({first})"]
    for k in range(most):
        run = "PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}s{k} AS (SELECT tree, pos, m,
            coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
          FROM {name}{k})""")
        out.append(f"""{name}{k + 1} AS (SELECT tree, pos // 3 AS pos, (m + 2) // 3 AS m,
            CASE WHEN m = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
          FROM {name}{k} GROUP BY tree, pos // 3, m)""")
    return out


def _climb(name: str, source: str, tree: str, most: int) -> list[str]:
    """``source`` with folded node f and proof p, carried up every level."""
    out, before = [], source
    for k in range(most):
        out.append(f"""{source}_{name}{k} AS (SELECT e.* EXCLUDE (f, p, place),
            CASE WHEN s.m > 1 THEN sha256(s.l || e.f || s.r) ELSE e.f END AS f,
            e.p || CASE WHEN s.m > 1 THEN s.l || s.r ELSE '' END AS p, e.place // 3 AS place
          FROM {before} e JOIN {name}s{k} s ON s.tree = e.{tree} AND s.pos = e.place)""")
        before = f"{source}_{name}{k}"
    return out


def merkle(leaf_levels: int = 12, source_levels: int = 6) -> str:
    """For up to 3^leaf_levels rows of a source and 3^source_levels sources."""
    def field(c):
        return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    parts = ["""bits AS (SELECT i, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) t(i)
        UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1
        FROM bits WHERE k < 8)""",
             "crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8)",
             f"""leaves AS (SELECT doc_id, coalesce('+' || source, '') AS tree, source,
        sha256({head} || {field('text')}) AS leaf,
        CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL AND list_reduce(
          list_prepend(CAST(4294967295 AS BIGINT), list_transform(
            string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
          lambda a, b: xor(a // 256, t[CAST(xor(a, b) % 256 AS INTEGER) + 1])) % 2 = 1
          THEN sha256({head} || {field("replace(text, chr(10), '')")}) END AS shown
        FROM documents, crc)""",
             """line AS (SELECT *, row_number() OVER (PARTITION BY tree
        ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS m FROM leaves)"""]
    parts += _levels("n", "SELECT tree, pos, m, leaf AS h FROM line", leaf_levels)
    parts.append(f"""subs AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos,
        count(*) OVER () AS m FROM n{leaf_levels})""")
    parts += _levels("q", "SELECT 1 AS tree, pos, m, h FROM subs", source_levels)
    parts.append("""start AS (SELECT l.doc_id, l.leaf, l.tree, 1 AS all_trees, s.h AS subroot, s.pos AS spos,
        coalesce(l.shown, l.leaf) AS f, '' AS p, l.pos AS place FROM line l JOIN subs s ON s.tree = l.tree)""")
    parts += _climb("n", "start", "tree", leaf_levels)
    parts.append(f"up AS (SELECT * REPLACE (spos AS place) FROM start_n{leaf_levels - 1})")
    parts += _climb("q", "up", "all_trees", source_levels)
    return "WITH RECURSIVE " + ",\n".join(parts) + f"""
      SELECT u.doc_id, u.leaf, u.subroot, r.h AS root, sha256(u.p) AS proof_sha256, u.f AS folded_root,
             u.f = r.h AS verified FROM up_q{source_levels - 1} u, q{source_levels} r"""


# ---- op9: sets of five-word shingles at 0.8 or more -----------------------------

JACCARD = """
  WITH RECURSIVE w AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN_]+') AS words FROM documents),
  s AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN []
          WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
          ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS g FROM w),
  reps AS MATERIALIZED (SELECT g, min(r) AS k, count(*) AS copies, min(doc_id) AS rep FROM s
           WHERE len(g) > 0 GROUP BY g),
  grams AS (SELECT k, unnest(g) AS gram FROM reps),
  shared AS (SELECT a.k AS a, b.k AS b, count(*) AS n FROM grams a JOIN grams b
             ON a.gram = b.gram AND a.k <> b.k GROUP BY 1, 2),
  links AS MATERIALIZED (SELECT a, b, y.copies FROM shared JOIN reps x ON x.k = a JOIN reps y ON y.k = b
            WHERE 5 * n >= 4 * (len(x.g) + len(y.g) - n)),
  reach AS (SELECT k, k AS seen FROM reps UNION SELECT reach.k, b FROM reach JOIN links ON a = seen),
  class AS (SELECT reach.k, min(o.rep) AS class_id FROM reach JOIN reps o ON o.k = seen GROUP BY 1)
  SELECT s.doc_id, coalesce(c.class_id, s.doc_id) AS class_id,
         CAST(coalesce(l.n, 0) + coalesce(p.copies - 1, 0) AS BIGINT) AS n_links
  FROM s LEFT JOIN reps p ON p.g = s.g AND len(s.g) > 0 LEFT JOIN class c ON c.k = p.k
  LEFT JOIN (SELECT a, sum(copies) AS n FROM links GROUP BY 1) l ON l.a = p.k"""
