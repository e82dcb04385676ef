"""Personal data by weak supervision, with DataFrame functions only.

Fixed patterns give the base spans.  Looser patterns propose more candidates.
Labelers vote on every candidate: whether it has the strict form, checks of its
digits, gazetteers (domains, calling codes, card issuers, address blocks, names of
secrets), words before it, and the characters at its edges.  Candidates are
counted by kind and votes, which gives a table of fixed size whatever the
corpus; on it expectation-maximisation estimates each labeler's reliability and
every pattern's probability, and a logistic span classifier is trained on these
soft labels.  Base spans stay; a candidate is added if the classifier accepts
it and it overlaps no base span.

The patterns are written with possessive repeats and look-behinds, which find
the same matches as the plain ones but need neither recursion nor repeated
scans on very long runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .native import cut, let, matches, pieces, scan
from .shared import free_name

#: In the order in which spans with the same start are listed; the last one is only ever added.
KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GAP = r"[^\p{L}0-9\n]{1,6}"
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++[\x20]?[\[(]at[\])][\x20]?[A-Za-z0-9-]++(?:(?:\.|[\x20]?[\[(]dot[\])][\x20]?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": rf"(?<![0-9+])[0-9]{{4}}(?:{_GAP}[0-9]{{4}}){{3}}(?![0-9])",
    "phone": rf"(?<![0-9])(?:\+[0-9]{{1,3}}{_GAP})?\([0-9]{{2,4}}\){_GAP}[0-9]{{3,4}}{_GAP}[0-9]{{3,4}}(?![0-9])",
    "secret": r"(?:(?i:password|passwd|secret|token|api_?key)[\x20]{0,2}[=:][\x20]{0,2}\"?[A-Za-z0-9+/_-]{8,256}\"?)|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
}
#: Texts without any of these characters hold no candidate.
_MAY = r"[0-9@=:\[(]"
LABELERS = ("strict", "digits", "gazetteer", "context", "edges")
_EM_STEPS, _FIT_STEPS, _SMOOTH = 30, 400, 1.0
ACCEPT = 0.5

#: Fixed values of the gazetteers, which are a parameter of the search.  Domains of two letters are countries'.
GAZETTEERS: dict[str, tuple[str, ...]] = {
    "domains": (
        "aero", "app", "arpa", "asia", "biz", "blog", "cat", "cloud", "club", "com", "coop", "dev", "edu", "example", "gov", "info", "int", "jobs", "mail", "mil", "mobi", "museum",
        "name", "net", "news", "online", "org", "page", "post", "pro", "shop", "site", "store", "tech", "tel", "test", "travel", "web", "wiki", "work", "xyz",
    ),
    "file suffixes": ("bmp", "cfg", "conf", "css", "csv", "exe", "gif", "htm", "html", "java", "jpeg", "jpg", "json", "log", "pdf", "php", "png", "svg", "tmp", "txt", "xml", "yaml", "yml", "zip"),
    "calling codes": (
        "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66",
        "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
    ),
    # zones in which all codes have three digits
    "calling zones": ("21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "80", "85", "87", "88", "96", "97", "99"),
    # of 13 to 19, of 16, and of 14 to 16 digits
    "card issuers": ("34", "35", "36", "37", "38", "39", "30", "4", "50", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "60", "62", "64", "65", "67"),
    # no hosts of their own: this network, loopback, link-local, multicast and above
    "reserved addresses": (r"0\.", r"127\.", r"169\.254\.", r"22[4-9]\.", r"2[345][0-9]\."),
    "private addresses": (r"10\.", r"192\.168\.", r"172\.(?:1[6-9]|2[0-9]|3[01])\."),
    "secret names": ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "access_key", "private_key", "client_secret", "bearer", "credential", "akia"),
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        double = F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + double

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """The condition that a match of the base pattern has to meet."""
    if kind == "ip":
        return value.rlike(r"^(?:0*+(?:[1-9]?[0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])?(?:\.|$)){4}$")
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _votes(kind: str, span: Column, strict: bool, lists: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """-1, 0 or 1 of each labeler on a candidate; none looks at what another one does."""
    value, before, after = span["value"], span["before"], span["after"]
    sign = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    any_of = lambda name: "|".join(lists[name])
    digits_of = _digits(value)
    count = F.length(digits_of)
    if kind == "email":
        digits = F.lit(0)
        domain = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
        gazetteer = sign(domain.isin(*lists["domains"]) | domain.rlike("^[a-z]{2}$") & ~domain.isin("js", "py"), domain.isin("js", "py", *lists["file suffixes"]) | domain.rlike("^[0-9]"))
    elif kind == "ip":
        digits = sign(_valid("ip", value) | value.contains(":"), ~_valid("ip", value))
        plain = F.regexp_replace(value, r"(?<![0-9])0++(?=[0-9])", "")
        reserved = plain.rlike(f"^(?:{any_of('reserved addresses')})")
        gazetteer = sign(~reserved & ~plain.rlike(f"^(?:{any_of('private addresses')})"), reserved)
    elif kind == "card":
        digits = sign(_valid("card", value), ~_valid("card", value))
        gazetteer = sign(digits_of.rlike(f"^(?:{any_of('card issuers')})"), ~digits_of.rlike(f"^(?:{any_of('card issuers')})"))
    elif kind == "phone":
        digits = sign(count.between(9, 15), ~count.between(7, 15))
        code = rf"^\+(?:(?:{any_of('calling codes')})|(?:{any_of('calling zones')})[0-9])[^0-9]"
        gazetteer = sign(value.rlike(code) | value.rlike(r"^\([2-9][0-9]{2}\)"), value.rlike(r"^\+0") | value.rlike(r"^\+[0-9]++[^0-9]") & ~value.rlike(code))
    else:
        digits = sign(value.rlike("[0-9]"), ~value.rlike("[0-9]"))
        name = value.rlike(f"(?i)^(?:{any_of('secret names')})")
        gazetteer = sign(name, ~name)
    words = {"email": "mail|contact|write", "ip": r"\bip\b|host|address|server", "card": "card|visa|credit|pay", "phone": "tel|phone|call|fax|mobile", "secret": "key|auth|login|config"}[kind]
    context = sign(before.rlike(f"(?i)(?:{words})"), before.rlike(r"(?i)(?:version|isbn|section|figure|\bv)[.\x20:]*$"))
    edges = sign(before.rlike(r"(?:^|[^\p{L}0-9_])$") & after.rlike(r"^(?:$|[^\p{L}0-9_])"), before.rlike(r"[\p{L}0-9_]$") & after.rlike(r"^[\p{L}0-9_]"))
    return {"strict": F.lit(1 if strict else 0), "digits": digits, "gazetteer": gazetteer, "context": context, "edges": edges}


_SPAN = "struct<start: int, rank: int, end: int>"


def _tagger(rank: int, kind: str, base: bool, lists: dict[str, tuple[str, ...]]):
    """Turns a match into a voted candidate; one of a base pattern also says whether it is valid."""

    def tag(span: Column) -> Column:
        votes = F.struct(*[v.cast("int").alias(n) for n, v in _votes(kind, span, base, lists).items()])
        return F.struct(span["start"].alias("start"), F.lit(rank).alias("rank"), span["end"].alias("end"), votes.alias("votes"))

    return (lambda span: F.struct(_valid(kind, span["value"]).alias("ok"), tag(span).alias("c"))) if base else tag


def _candidates(docs: DataFrame, text: Column, base: str, cand: str, lists: dict[str, tuple[str, ...]]) -> DataFrame:
    """Add the base spans and the voted candidates of every text as array columns."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    may = text.rlike(_MAY)
    vote_fields = ", ".join(f"{n}: int" for n in LABELERS)
    bases, cands = [], []
    for rank, kind in enumerate(KINDS):
        if kind in BASE:
            bases.append(F.transform(matches(text, BASE[kind], 24), _tagger(rank, kind, True, lists)))
        cands.append(F.transform(matches(text, LOOSE[kind], 24), _tagger(rank, kind, False, lists)))
    kind_type = f"struct<start: int, rank: int, end: int, votes: struct<{vote_fields}>>"
    none = F.array().cast(f"array<struct<ok: boolean, c: {kind_type}>>")
    docs = docs.withColumn(base, F.when(may, F.concat(*bases)).otherwise(none))
    return docs.withColumn(cand, F.when(may, F.concat(*cands)).otherwise(F.array().cast(f"array<{kind_type}>")))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(table: list[tuple]) -> dict:
    """Labeler reliabilities by expectation-maximisation, then a logistic classifier.

    ``table`` has a row (rank, a vote of each labeler, count) for each pattern:
    at most 5 * 3**5 of them whatever the corpus, so they are worked on here.
    """
    rows = sorted((int(r[0]), tuple(map(int, r[1:-1])), float(r[-1])) for r in table)
    begin = {-1: 0.15, 0: 0.35, 1: 0.5}
    sides = {True: begin, False: {-v: p for v, p in begin.items()}}
    given = {side: [dict(first) for _ in LABELERS] for side, first in sides.items()}
    prior = [0.7] * len(KINDS)

    def posterior() -> list[float]:
        return [
            _sigmoid(math.log(prior[k] / (1 - prior[k])) + sum(math.log(given[True][i][v]) - math.log(given[False][i][v]) for i, v in enumerate(votes)))
            for k, votes, _ in rows
        ]

    for _ in range(_EM_STEPS):
        belief = posterior()
        for side, first in sides.items():
            weight = [n * (p if side else 1 - p) for (_, _, n), p in zip(rows, belief, strict=True)]
            total = sum(weight) + 3 * _SMOOTH
            for i in range(len(LABELERS)):
                # a little of the start stays, so no probability becomes 0
                given[side][i] = {v: (sum(w for w, r in zip(weight, rows, strict=True) if r[1][i] == v) + 3 * _SMOOTH * first[v]) / total for v in begin}
        for k in range(len(KINDS)):
            mine = [(n, p) for (own, _, n), p in zip(rows, belief, strict=True) if own == k]
            prior[k] = (sum(n * p for n, p in mine) + 7 * _SMOOTH) / (sum(n for n, _ in mine) + 10 * _SMOOTH)

    soft = posterior()
    made = [_features(k, votes) for k, votes, _ in rows]
    weight = [math.sqrt(n) for _, _, n in rows]
    total, names = sum(weight) or 1.0, list(_features(0, (0,) * len(LABELERS)))
    weights, speed = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    for _ in range(_FIT_STEPS):
        error = [(p - _sigmoid(sum(weights[f] for f in own))) * w for p, own, w in zip(soft, ([f for f, x in m.items() if x] for m in made), weight, strict=True)]
        for f in names:
            gradient = sum(e for e, m in zip(error, made, strict=True) if m[f]) / total - 1e-3 * weights[f]
            speed[f] = 0.8 * speed[f] + 0.5 * gradient
        for f in names:
            weights[f] += speed[f]
    reliability = {"yes" if side else "no": dict(zip(LABELERS, values, strict=True)) for side, values in given.items()}
    return {"reliability": reliability, "prior": dict(enumerate(prior)), "weights": weights, "soft": {(k, votes): p for (k, votes, _), p in zip(rows, soft, strict=True)}}


def _features(rank, votes) -> dict:
    """1 for what holds of a kind and its votes, as numbers or as columns."""
    out = {"one": True} | {f"kind{k}": rank == k for k in range(1, len(KINDS))}
    return out | {f"{n}{v}": c == v for n, c in zip(LABELERS, votes, strict=True) for v in (-1, 1)}


def _accept(candidate: Column, weights: dict[str, float], threshold: float) -> Column:
    made = _features(candidate["rank"], [candidate["votes"][n] for n in LABELERS])
    z = F.lit(weights["one"])
    for name, w in weights.items():
        if name != "one":
            z = z + F.when(made[name], w).otherwise(0.0)
    return z >= math.log(threshold / (1 - threshold))


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = ACCEPT, name: str = "pii", gazetteers: dict[str, tuple[str, ...]] = GAZETTEERS) -> tuple[DataFrame, str, dict]:
    """Add a struct column with the personal data in every whole text.

    Fields: ``base`` and ``spans``, arrays of (start, rank, end) in order, where
    rank is the place in KINDS; positions count code points.  ``spans`` has the
    base spans and what the classifier adds.  Null and empty texts have none;
    each input row gives one row, repeated or not, with all its columns; an
    empty table gives none.  Returns the frame, the column's name (with
    underscores added where the documents have such a column) and what was
    learned.
    """
    name, base = free_name(docs, name), free_name(docs, "pii_base")
    cand = free_name(docs, "pii_candidates")
    voted = _candidates(docs.select(F.col(text_col).alias("text")), F.col("text"), "base", "cand", gazetteers)
    rows = voted.select(F.explode(F.concat(F.transform("base", lambda b: b["c"]), "cand")).alias("c")).select("c.rank", "c.votes.*")
    learned = learn(rows.groupBy("rank", *LABELERS).agg(F.count("*").alias("n")).collect())

    found = _candidates(docs, F.col(text_col), base, cand, gazetteers)
    plain = lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"))
    kept = F.sort_array(F.transform(F.filter(base, lambda b: b["ok"]), lambda b: plain(b["c"])))
    accepted = F.transform(F.filter(cand, lambda c: _accept(c, learned["weights"], threshold)), plain)

    def merge(both: Column) -> Column:
        known, new = both["known"], both["new"]
        spans = F.when(F.size(new) == 0, known).otherwise(F.sort_array(F.concat(known, _apart(known, new))))
        return F.struct(known.alias("base"), spans.alias("spans"))

    return found.withColumn(name, let(F.struct(kept.alias("known"), accepted.alias("new")), merge)).drop(base, cand), name, learned


def _apart(known: Column, new: Column) -> Column:
    """New spans that touch no known one, without those that overlap an earlier new one."""
    flag = lambda spans, is_new: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.lit(is_new).alias("new")))
    ordered = F.sort_array(F.concat(flag(known, False), flag(new, True)))

    def free(every: Column) -> Column:
        # how far the known ones before reach, and where the next one begins
        reach = scan(every, F.lit(0), lambda at, s: (F.when(s["new"], at).otherwise(F.greatest(at, s["end"])), at), "int", "int")
        ahead = F.reverse(scan(F.reverse(every), F.lit(2**31 - 1), lambda at, s: (F.when(s["new"], at).otherwise(s["start"]), at), "int", "int"))
        sides = F.zip_with(reach, ahead, lambda r, a: F.struct(r.alias("reach"), a.alias("ahead")))
        marked = F.zip_with(every, sides, lambda s, e: F.struct(s.alias("s"), (s["new"] & (e["reach"] <= s["start"]) & (e["ahead"] >= s["end"])).alias("free")))
        return F.transform(F.filter(marked, lambda m: m["free"]), lambda m: F.struct(m["s"]["start"].alias("start"), m["s"]["rank"].alias("rank"), m["s"]["end"].alias("end")))

    def first(spans: Column) -> Column:
        open_ = scan(spans, F.lit(0), lambda at, s: (F.when(s["start"] >= at, s["end"]).otherwise(at), s["start"] >= at), "int", "boolean")
        both = F.zip_with(spans, open_, lambda s, o: F.struct(s.alias("s"), o.alias("o")))
        return F.transform(F.filter(both, lambda b: b["o"]), lambda b: b["s"])

    return let(let(ordered, free), first)


def count_kind(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", threshold: float = ACCEPT) -> DataFrame:
    """Replace personal data by its kind in angle brackets; overlapping spans become one.

    All rows and columns stay; a text without such data is unchanged, a null
    text stays null.
    """
    found, name, _ = find_pii(docs, text_col, threshold)
    marks = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col(text_col)
    kind = "struct<at: int, start: int, rank: int, open: boolean>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(at, s["end"]), F.struct(at.alias("at"), s["start"].alias("start"), s["rank"].alias("rank"), (s["start"] >= at).alias("open"))

    def build(both: Column) -> Column:
        steps, parts = both["steps"], both["parts"]
        shown = F.transform(steps, lambda e: F.when(e["open"], F.concat(cut(parts, e["at"], e["start"]), F.element_at(marks, e["rank"] + 1))).otherwise(""))
        return F.concat(F.array_join(shown, ""), cut(parts, both["last"], F.length(text)))

    spans = F.col(name)["spans"]
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    clean = let(F.struct(scan(spans, F.lit(0), step, "int", kind).alias("steps"), pieces(text).alias("parts"), last.alias("last")), build)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).select(*docs.columns)
