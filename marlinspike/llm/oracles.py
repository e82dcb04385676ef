"""DuckDB SQL for the training-text queries that SQL can express on whole tables."""

_NORM = "lower(trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g')))"

CHAT_FORMAT = rf"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS rid, conv_id, CAST(turn AS BIGINT) AS turn, role, replace(coalesce(text, ''), chr(13), '') AS text FROM conversations
), split AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM base
), leveled AS (
  SELECT rid, pos, line, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]*)*)', 1), '[^>]', '', 'g')) AS level FROM split
), bodies AS (
  SELECT rid, pos, level, CASE WHEN level > 0 THEN regexp_replace(line, '^[ \t]*((?:>[ \t]*)*)', '') ELSE line END AS body FROM leveled
), said AS (
  SELECT * FROM bodies WHERE NOT regexp_matches(trim(body), '^(On|Le|Am|El) .*(wrote|écrit|schrieb|escribió) ?:$')
), edges AS (
  SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY rid ORDER BY pos) THEN 1 ELSE 0 END AS opens FROM said
), numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY rid ORDER BY pos) AS run FROM edges
), runs AS (
  SELECT rid, run, any_value(level) AS level, {_NORM.format("string_agg(body, chr(10) ORDER BY pos)")} AS norm,
    list({_NORM.format("body")} ORDER BY pos) FILTER ({_NORM.format("body")} <> '') AS lines FROM numbered GROUP BY rid, run
), own AS (
  SELECT rid, regexp_replace(string_agg(body, chr(10) ORDER BY pos), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS content FROM said WHERE level = 0 GROUP BY rid
), levels AS (
  SELECT rid, max(level) AS max_level FROM said GROUP BY rid
), passages AS (
  SELECT DISTINCT b.rid, b.conv_id, b.turn, r.level, r.norm, r.lines FROM runs r JOIN base b USING (rid)
  WHERE r.level > 0 AND length(r.norm) > 0 AND b.conv_id IS NOT NULL AND b.turn IS NOT NULL
), written AS (
  SELECT conv_id, turn, {_NORM.format("content")} AS norm, list_filter(list_transform(string_split(content, chr(10)), lambda x: {_NORM.format("x")}), lambda x: x <> '') AS lines
  FROM own JOIN base USING (rid) WHERE turn IS NOT NULL AND {_NORM.format("content")} <> ''
), linked AS (
  SELECT p.rid, p.level, p.norm, max(w.turn) AS source FROM passages p JOIN written w ON p.conv_id = w.conv_id AND w.turn < p.turn
  WHERE w.norm = p.norm OR list_contains(w.lines, p.norm)
    OR (len(string_split(p.norm, ' ')) >= 5 AND contains(' ' || w.norm || ' ', ' ' || p.norm || ' '))
    OR (len(p.lines) > 1 AND len(list_filter(range(1, len(w.lines) - len(p.lines) + 2), lambda i: w.lines[i:i + len(p.lines) - 1] = p.lines)) > 0)
  GROUP BY ALL
), links AS (
  SELECT rid, count(*) AS n_linked, min(level) AS first_level FROM linked GROUP BY rid
), first AS (
  SELECT l.rid, max(l.source) AS reply_to, max(k.n_linked) AS n_linked FROM linked l JOIN links k ON l.rid = k.rid AND l.level = k.first_level GROUP BY l.rid
), counts AS (
  SELECT rid, count(DISTINCT (level, norm)) AS n_quotes FROM passages GROUP BY rid
), parents AS (
  SELECT conv_id, turn, max(reply_to) AS up FROM base LEFT JOIN first USING (rid) WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), tree AS (
  SELECT conv_id, turn, turn AS thread FROM parents WHERE up IS NULL
  UNION ALL SELECT p.conv_id, p.turn, t.thread FROM parents p JOIN tree t ON p.conv_id = t.conv_id AND p.up = t.turn
), places AS (
  SELECT conv_id, turn, thread, row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn) - 1 AS position FROM tree
)
SELECT b.conv_id, b.turn, b.role, coalesce(o.content, '') AS content, CAST(coalesce(c.n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(f.n_linked, 0) AS BIGINT) AS n_linked,
  CAST(coalesce(l.max_level, 0) AS BIGINT) AS max_level, f.reply_to, p.thread, CAST(p.position AS BIGINT) AS position
FROM base b LEFT JOIN own o USING (rid) LEFT JOIN counts c USING (rid) LEFT JOIN first f USING (rid) LEFT JOIN levels l USING (rid)
LEFT JOIN places p ON b.conv_id = p.conv_id AND b.turn = p.turn
"""

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = f"translate(coalesce(text, ''), '{_A}', '{_Z}')"
_NON_SPACE, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(source: str, name: str, key: str, text: str, pattern: str) -> str:
    """Tables ``name``_rows (rid, the key) and ``name`` (rid, pos, word) of all words of all rows."""
    return rf"""{name}_rows AS (
  SELECT row_number() OVER () AS rid, {key}, regexp_extract_all({text}, '{pattern}') AS words FROM {source}
), {name} AS (
  SELECT rid, generate_subscripts(words, 1) AS pos, unnest(words) AS word FROM {name}_rows
)"""


def _runs(most: int) -> str:
    """A list of the runs of 1 to ``most`` words from a word on; those beyond the text's end are null."""
    parts = ["word", *(f"lead(word, {i}) OVER w" for i in range(1, most))]
    return "[" + ", ".join(" || ' ' || ".join(parts[:n]) for n in range(1, most + 1)) + "]"


NGRAM_JACCARD = f"""
WITH RECURSIVE {_words("documents", "said", "doc_id", _LOWER, _NON_SPACE)}, shingles AS (
  SELECT DISTINCT rid, run AS shingle FROM (SELECT rid, {_runs(5)}[5] AS run FROM said WINDOW w AS (PARTITION BY rid ORDER BY pos)) WHERE run IS NOT NULL
  UNION ALL SELECT rid, array_to_string(words, ' ') FROM said_rows WHERE len(words) BETWEEN 1 AND 4
), sets AS (
  SELECT rid, doc_id, size, mark FROM (SELECT rid, count(*) AS size, md5(string_agg(md5(shingle), '' ORDER BY shingle)) AS mark FROM shingles GROUP BY rid) JOIN said_rows USING (rid)
), classes AS (
  SELECT mark, min(rid) AS rid, any_value(size) AS size, min(doc_id) AS class_id FROM sets GROUP BY mark
), held AS (
  SELECT c.mark, c.size, s.shingle FROM classes c JOIN shingles s USING (rid)
), linked AS (
  SELECT a.mark AS a, b.mark AS b FROM held a JOIN held b ON a.shingle = b.shingle AND a.mark <> b.mark GROUP BY a.mark, b.mark, a.size, b.size
  HAVING 100 * count(*) >= 80 * (a.size + b.size - count(*))
  UNION SELECT a.mark, b.mark FROM sets a JOIN sets b ON a.doc_id = b.doc_id AND a.mark <> b.mark
), reach AS (
  SELECT mark, mark AS place FROM classes UNION SELECT r.mark, l.b FROM reach r JOIN linked l ON l.a = r.place
), groups AS (
  SELECT r.mark, min(c.class_id) AS component_id FROM reach r JOIN classes c ON c.mark = r.place GROUP BY r.mark
)
SELECT d.doc_id, coalesce(s.size, 0)::BIGINT AS n_shingles, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(g.component_id, d.doc_id) AS component_id
FROM said_rows d LEFT JOIN sets s USING (rid) LEFT JOIN classes c ON c.mark = s.mark LEFT JOIN groups g ON g.mark = s.mark
"""

DECONTAMINATION = f"""
WITH {_words("documents", "said", "doc_id", _LOWER, _ALNUM)}, {_words("benchmark WHERE item_id IS NOT NULL", "asked", "item_id", _LOWER, _ALNUM)}, said_runs AS (
  SELECT * FROM (SELECT rid, pos, generate_subscripts(runs, 1) AS k, unnest(runs) AS run FROM (SELECT rid, pos, {_runs(10)} AS runs FROM said WINDOW w AS (PARTITION BY rid ORDER BY pos))) WHERE run IS NOT NULL
), asked_runs AS (
  SELECT * FROM (SELECT rid, pos, generate_subscripts(runs, 1) AS k, unnest(runs) AS run FROM (SELECT rid, pos, {_runs(10)} AS runs FROM asked WINDOW w AS (PARTITION BY rid ORDER BY pos))) WHERE run IS NOT NULL
), windows AS (
  SELECT r.*, a.item_id FROM asked_runs r JOIN asked_rows a USING (rid) WHERE r.k = least(10, len(a.words))
), hits AS (
  SELECT s.rid, s.pos, s.k, w.rid AS item, w.pos AS item_pos, w.item_id FROM said_runs s JOIN windows w ON s.k = w.k AND s.run = w.run
), places AS (
  SELECT DISTINCT rid, pos FROM hits
), covered AS (
  SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + k)) AS place FROM hits) GROUP BY rid
), named AS (
  SELECT rid, list(DISTINCT item_id::VARCHAR) AS items FROM hits GROUP BY rid
), diagonals AS (
  SELECT rid, item, pos - item_pos AS diagonal, pos - row_number() OVER (PARTITION BY rid, item, pos - item_pos ORDER BY pos) AS island FROM hits WHERE k = 10
), lengths AS (
  SELECT rid, count(*) + 9 AS length FROM diagonals GROUP BY rid, item, diagonal, island
  UNION ALL SELECT s.rid, s.k FROM said_runs s JOIN places USING (rid, pos) WHERE EXISTS (FROM asked_runs a WHERE a.k = s.k AND a.run = s.run)
), best AS (
  SELECT rid, max(length) AS longest FROM lengths GROUP BY rid
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest_match
FROM said_rows d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid) LEFT JOIN best USING (rid)
"""

#: Marks of 2, 4, ... words from a word on are made of those of half as many.
SUBSTRING_DEDUP = f"""
WITH {_words("documents", "said", "doc_id", "coalesce(text, '')", _NON_SPACE)}, m1 AS (
  SELECT rid, pos, word, md5(word) AS h1 FROM said
), m2 AS (SELECT *, md5(h1 || lead(h1, 1) OVER w) AS h2 FROM m1 WINDOW w AS (PARTITION BY rid ORDER BY pos)
), m4 AS (SELECT *, md5(h2 || lead(h2, 2) OVER w) AS h4 FROM m2 WINDOW w AS (PARTITION BY rid ORDER BY pos)
), m8 AS (SELECT *, md5(h4 || lead(h4, 4) OVER w) AS h8 FROM m4 WINDOW w AS (PARTITION BY rid ORDER BY pos)
), m16 AS (SELECT *, md5(h8 || lead(h8, 8) OVER w) AS h16 FROM m8 WINDOW w AS (PARTITION BY rid ORDER BY pos)
), m32 AS (SELECT *, md5(h16 || lead(h16, 16) OVER w) AS h32 FROM m16 WINDOW w AS (PARTITION BY rid ORDER BY pos)
), m35 AS (SELECT rid, pos, word, md5(h32 || lead(h2, 32) OVER w || lead(h1, 34) OVER w) AS mark FROM m32 WINDOW w AS (PARTITION BY rid ORDER BY pos)
), repeated AS (
  SELECT mark FROM m35 WHERE mark IS NOT NULL GROUP BY mark HAVING count(*) > 1
), flagged AS (
  SELECT rid, pos, word, mark IN (FROM repeated) AS again FROM m35
), covered AS (
  SELECT rid, pos, word, bool_or(coalesce(again, false)) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM flagged
), counted AS (
  SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM covered GROUP BY rid
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM said_rows d LEFT JOIN counted USING (rid)
"""


def _vector_codes(rounds: int = 4) -> str:
    """Squared distances as whole numbers in doubles: exact for components far below 2**20."""
    out = """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT rid, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS v FROM kept, range(4) AS r(part)
), book0 AS MATERIALIZED (
  SELECT part, rid - 1 AS entry, v FROM parts WHERE rid <= 256
)"""
    for n in range(rounds + 1):
        out += f""", found{n} AS MATERIALIZED (
  SELECT rid, part, min(struct_pack(d := list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v), e := b.entry)) AS best
  FROM parts p JOIN book{n} b USING (part) GROUP BY rid, part
)"""
        if n < rounds:
            out += f""", sums{n} AS (
  SELECT part, entry, list(m ORDER BY place) AS v FROM (
    SELECT part, f.best.e AS entry, place, floor(sum(p.v[place]) / count(*)) AS m
    FROM found{n} f JOIN parts p USING (rid, part), unnest(range(1, len(p.v) + 1)) AS u(place) GROUP BY ALL
  ) GROUP BY part, entry
), book{n + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(s.v, b.v) AS v FROM book{n} b LEFT JOIN sums{n} s USING (part, entry)
)"""
    return out + f""", coded AS (
  SELECT rid, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM found{rounds} GROUP BY rid
), books AS (
  SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}
)
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, codebooks_sha256 FROM kept k JOIN coded c USING (rid), books
"""


VECTOR_CODES = _vector_codes()

#: Every kept term of a language against every group of it; whole numbers of 128 bits.
SOURCE_DIVERGENCE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS text FROM documents
), said AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), terms AS (
  SELECT lang, term, count(*) AS c FROM said GROUP BY lang, term HAVING count(DISTINCT rid) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(c) AS n FROM terms GROUP BY lang
), q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (c + 2) // (n + 2 * v) AS q FROM terms JOIN langs USING (lang)
), held AS (
  SELECT lang, source, term, count(*) AS c FROM said SEMI JOIN terms USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT d.lang, d.source, coalesce(any_value(v), 0) AS v, (SELECT coalesce(sum(c), 0) FROM held h WHERE h.lang = d.lang AND h.source = d.source) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN langs USING (lang) GROUP BY d.lang, d.source
), p AS (
  SELECT g.lang, g.source, t.term, coalesce(h.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(h.c, 0) + 2) // (g.n + 2 * g.v) AS p
  FROM groups g JOIN terms t USING (lang) LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = t.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), tops AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM tops
)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= 10
"""
