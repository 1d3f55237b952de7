"""Personal data: regex, gazetteer and context labelers, weighed by expectation-maximisation, train a span classifier.

All rows are handled by DataFrame functions. The driver sees one row for each kind and pattern of votes: at most
kinds * 3 ** labelers * 2 ** features, whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, text_or_empty

#: Patterns of candidates by kind, the first four as in the base definition. Possessive repeats and look-behinds
#: change no match, only the work on long runs. The others propose widely: whatever one labeler may take for the kind.
NAMES = "pass(?:word|wd|phrase)?|pwd|credential|(?:api|access|private|secret|auth)[_-]?key|(?:client|app)?[_-]?secret|(?:auth|access|bearer|refresh|api)?[_-]?token"
ASSIGNED = rf"(?i:{NAMES})[\"']?[\x20]*(?:=>|:=|[:=])[\x20]*[\"']?"
PREFIXES = "AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|pk_|sk_|rk_|xox[abpr]-|AIza|ya29\\.|eyJ"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": rf"(?<![A-Za-z0-9]){ASSIGNED}[^\x20\x09-\x0D\"'<>,;]{{6,}}+|(?<![A-Za-z0-9_+.@-])(?=[A-Za-z_+.-]*+[0-9])(?=[0-9_+.-]*+[A-Za-z])[A-Za-z0-9_+.-]{{16,}}+(?!@)",
    "ssn": r"(?<![0-9-])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+)][\x20.-])(?<![0-9+(.-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){3,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: The gazetteers (beginnings or endings, well-known prefixes of keys, placeholders, countries of accounts).
DOMAINS = "com org net edu gov io de fr es uk".split()
COUNTRY_CODES = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 55 61 81 82 86 90 91".split()
CARD_BEGINNINGS = "4 5 34 36 37 38 6011 62 64 65 2".split()
PLACEHOLDERS = "example|sample|dummy|placeholder|changeme|change_me|your[_-]|xxxx|^0+$|^1234567|\\*\\*\\*|\\.\\.\\.|^(?:none|null|undefined|redacted)$"
IBAN_COUNTRIES = "AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
#: Context words for and against, near before a candidate.
CONTEXT = {
    "email": "mail|contact|write|@",
    "ip": "ip|host|server|address|addr|ping",
    "card": "card|visa|master|credit|pay",
    "phone": "call|phone|tel|fax|mobile|contact",
    "secret": f"{NAMES}|login|credential|authorization|secret",
    "ssn": "ssn|social|security|tax",
    "local_phone": "call|phone|tel|fax|mobile|contact|dial",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
AGAINST = {
    "secret": "commit|sha|md5|checksum|digest|hash|revision|uuid|guid|etag|version|isbn|https?:|www\\.|/",
    "ssn": "isbn|part|order|version|ticket|no\\.|#",
    "local_phone": "isbn|part|order|version|ticket|no\\.|#|\\$",
    "iban": "isbn|serial|part|key",
}
CONTEXT_CHARS = 40
ROUNDS = 30


def _luhn(digits: Column) -> Column:
    """Whether the digits, an array of one-character strings, pass the Luhn check."""
    n = F.size(digits)
    value = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)).otherwise(d.cast("int")).cast("int"))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """The check that a match of its kind must pass."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(F.split(digits, ""))).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def candidates(docs: DataFrame) -> DataFrame:
    """``row, doc_id, kind, start, stop, ok, match, before, named`` for every match, and one row without a kind for each text.

    ``ok`` is the check of a base kind. The match of an assignment to a secret's name is the value alone, ``named`` says so.

    Offsets count code points, the end is exclusive. Matches and the gaps between them are cut out by the same
    pattern; sums of their lengths within a text give the offsets.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("text"))
    has_digit = F.col("text").rlike("[0-9]")
    found = []
    for kind, pattern in PATTERNS.items():
        may = F.contains("text", F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
        may = may & has_digit if kind not in ("email", "secret") else may
        match = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        gaps = F.transform(F.split("text", pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(CONTEXT_CHARS)).alias("before")))
        pairs = F.zip_with(match, gaps, lambda m, g: F.struct(F.lit(kind).alias("kind"), m.alias("match"), g["n"].alias("gap"), g["before"].alias("before")))
        found.append(F.when(may & F.col("text").rlike(pattern), F.filter(pairs, lambda p: p["match"].isNotNull())))
    shape = "array<struct<kind:string,match:string,gap:int,before:string>>"
    text_itself = F.array(F.struct(*[F.lit(None).cast("string")] * 2, F.lit(0), F.lit(None).cast("string"))).cast(shape)
    every = F.concat(text_itself, *[F.coalesce(f, F.array().cast(shape)) for f in found])
    out = rows.select("row", "doc_id", F.posexplode(every).alias("at", "m")).select("row", "doc_id", "at", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("match")).over(upto)
    ok = F.lit(False)
    for kind in BASE:
        ok = F.when(F.col("kind") == kind, valid(kind, F.col("match"))).otherwise(ok)
    value = F.when(F.col("kind") == "secret", F.regexp_replace("match", f"^{ASSIGNED}", "")).otherwise(F.col("match"))
    out = out.select("row", "doc_id", "kind", stop.alias("stop"), ok.alias("ok"), value.alias("match"), "before", (F.length(value) < F.length("match")).alias("named"))
    return out.select("row", "doc_id", "kind", (F.col("stop") - F.length("match")).alias("start"), "stop", "ok", "match", "before", "named")


VOTES = ("regex", "gazetteer", "context")
#: Reliabilities that the estimate begins with, on true spans and on others; beginnings count for BELIEF votes. That of the
#: gazetteer on true spans is not estimated: what it lists as a placeholder hardly ever is personal data, however many other labelers like
#: its shape, and votes alone can't tell who of a minority and a majority is right.
BELIEFS = {"regex": (0.9, 0.9), "gazetteer": (0.995, 0.9), "context": (0.9, 0.9)}
FIXED = ("gazetteer",)
BELIEF = 10
#: What the classifier sees of a candidate beside its kind and the votes on it: features of the span itself.
FEATURES = ("long", "hex", "mixed", "varied", "digits")


def _iban(match: Column) -> Column:
    """Whether an account number has the remainder 1 modulo 97, its letters read as 10 to 35."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4))), "")
    value = F.transform(turned, lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def votes(found: DataFrame) -> DataFrame:
    """Adds ``regex, gazetteer, context`` (1, 0 to abstain, -1) and FEATURES (booleans) to the candidates."""
    digits = F.regexp_replace("match", "[^0-9]", "")
    starts = lambda c, names: c.rlike("^(?:" + "|".join(names) + ")")
    shaped = {kind: _vote(F.col("ok"), ~F.col("ok")) for kind in BASE} | {
        "secret": _vote(F.col("named"), ~F.col("named") & ~F.col("match").rlike(f"^(?:{PREFIXES})")),
        "ssn": _vote(~F.col("match").rlike("^(?:000|666|9)|[- ]00[- ]|[- ]0000$"), F.lit(True)),
        "local_phone": _vote(digits.rlike("^[2-9][0-9]{2}[2-9]"), F.lit(True)),
        "iban": _vote(_iban(F.col("match")), F.lit(True)),
    }
    listed = {
        "email": _vote(F.lower("match").rlike(r"\.(?:" + "|".join(DOMAINS) + ")$"), F.col("match").rlike(r"\.[0-9-]+$")),
        "ip": _vote(starts(F.col("match"), [r"10\.", r"192\.168\.", r"172\.(?:1[6-9]|2[0-9]|3[01])\."]), starts(F.col("match"), [r"0\."])),
        "card": _vote(starts(digits, CARD_BEGINNINGS), ~starts(digits, CARD_BEGINNINGS)),
        "phone": _vote(starts(digits, COUNTRY_CODES), starts(digits, ["0"])),
        "secret": F.when(F.col("match").rlike(f"(?i){PLACEHOLDERS}"), -1).when(F.col("match").rlike(f"^(?:{PREFIXES})"), 1).otherwise(0),
        "ssn": _vote(F.lit(False), starts(digits, ["123456789", "078051120"])),
        "local_phone": _vote(F.lit(False), digits.rlike("^(?:1234567|0)")),
        "iban": _vote(starts(F.col("match"), IBAN_COUNTRIES), ~starts(F.col("match"), IBAN_COUNTRIES)),
    }
    near, other, regex, gazetteer = F.lit(False), F.lit(False), F.lit(0), F.lit(0)
    for kind in KINDS:
        is_kind = F.col("kind") == kind
        near = F.when(is_kind, F.lower("before").rlike(f"(?:{CONTEXT[kind]})")).otherwise(near)
        other = F.when(is_kind, F.lower("before").rlike(f"(?:{AGAINST[kind]})") if kind in AGAINST else F.col("before").rlike(r"(?i)(?:version|isbn|no\.|#|\$)[\x20:=]*$")).otherwise(other)
        regex = F.when(is_kind, shaped[kind]).otherwise(regex)
        gazetteer = F.when(is_kind, listed[kind]).otherwise(gazetteer)
    context = F.when(other, -1).when(near | F.col("named"), 1).otherwise(0)
    m = F.col("match")
    return found.withColumns({
        "regex": regex, "gazetteer": gazetteer, "context": context, "long": F.length(m) >= 20, "hex": m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "mixed": m.rlike("[0-9]") & m.rlike("[A-Za-z]"), "varied": F.size(F.array_distinct(F.split(m, ""))) >= 10, "digits": m.rlike("^[^A-Za-z]+$"),
    })


def reliabilities(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple[float, float]], list[float]]:
    """Reliabilities of the labelers, and the probability of each pattern, from patterns of votes with their counts.

    Dawid-Skene by expectation-maximisation: each labeler that votes has a chance to be right on true spans and one on
    others, both with a Beta prior by BELIEFS; an abstention says nothing. The share of true spans has a Beta(2, 2) prior.
    """
    right = [BELIEFS[v] for v in VOTES]
    share, p = 0.5, [0.5] * len(patterns)
    for _ in range(ROUNDS):
        for k, (vote, _) in enumerate(patterns):
            odds = math.log(share / (1 - share))
            for v, (yes, no) in zip(vote, right, strict=True):
                odds += math.log(yes / (1 - no)) if v > 0 else math.log((1 - yes) / no) if v < 0 else 0.0
            p[k] = 1 / (1 + math.exp(-odds))
        total = sum(n for _, n in patterns)
        share = (1 + sum(n * q for (_, n), q in zip(patterns, p, strict=True))) / (2 + total)
        share = min(0.95, max(0.05, share))
        for j in range(len(VOTES)):
            on_true = [(n * q, v[j]) for (v, n), q in zip(patterns, p, strict=True) if v[j]]
            on_false = [(n * (1 - q), v[j]) for (v, n), q in zip(patterns, p, strict=True) if v[j]]
            yes, no = BELIEFS[VOTES[j]]
            if VOTES[j] not in FIXED:
                yes = (yes * BELIEF + sum(w for w, v in on_true if v > 0)) / (BELIEF + sum(w for w, _ in on_true))
            no = (no * BELIEF + sum(w for w, v in on_false if v < 0)) / (BELIEF + sum(w for w, _ in on_false))
            right[j] = (min(0.998, max(0.55, yes)), min(0.998, max(0.55, no)))  # better than chance, or classes could swap
    return right, p


def _row(kind: str, vote: tuple[int, ...], features: tuple[bool, ...]) -> list[float]:
    """What the classifier weighs: for the kind alone, its votes either way, and the features of its spans."""
    one = [1.0, *[float(v > 0) for v in vote], *[float(v < 0) for v in vote], *[float(f) for f in features]]
    return [x if k == kind else 0.0 for k in KINDS for x in one]


def train(counts: list[tuple[str, tuple[int, ...], tuple[bool, ...], int]], steps: int = 500, rate: float = 2.0) -> list[float]:
    """Weights of a logistic classifier on votes and features by kind, fitted to the labels that the labelers' model gives.

    ``counts`` has a row for each kind, pattern of votes and pattern of features, with the candidates that have it.
    """
    target: dict[tuple, float] = {}
    for kind in KINDS:
        by_vote: dict[tuple[int, ...], int] = {}
        for k, v, _, n in counts:
            if k == kind:
                by_vote[v] = by_vote.get(v, 0) + n
        if by_vote:
            patterns = sorted(by_vote.items())
            target |= {(kind, v): q for (v, _), q in zip(patterns, reliabilities(patterns)[1], strict=True)}
    weights: list[float] = []
    size = 1 + 2 * len(VOTES) + len(FEATURES)
    for at, kind in enumerate(KINDS):
        rows = [(_row(k, v, f)[at * size : (at + 1) * size], target[k, v], math.sqrt(n)) for k, v, f, n in counts if k == kind]  # damped: no pattern drowns another
        total = sum(n for _, _, n in rows) or 1.0
        w = [0.0] * size
        for _ in range(steps if rows else 0):
            slope = [0.002 * x for x in w]
            for x, q, n in rows:
                miss = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))) - q
                for j, b in enumerate(x):
                    if b:
                        slope[j] += n / total * miss
            w = [a - rate * s for a, s in zip(w, slope, strict=True)]
        weights += w
    return weights


def probability(weights: list[float]) -> Column:
    sign = [F.when(F.col(v) > 0, 1.0).otherwise(0.0) for v in VOTES] + [F.when(F.col(v) < 0, 1.0).otherwise(0.0) for v in VOTES]
    columns = [F.lit(1.0), *sign, *[F.col(f).cast("double") for f in FEATURES]]
    score = F.lit(None).cast("double")
    for at, kind in enumerate(KINDS):
        one = F.lit(0.0)
        for w, c in zip(weights[at * len(columns) : (at + 1) * len(columns)], columns, strict=True):
            one = one + F.lit(w) * c
        score = F.when(F.col("kind") == kind, one).otherwise(score)
    return 1 / (1 + F.exp(-score))


def judged(docs: DataFrame) -> DataFrame:
    """``row, doc_id, kind, start, stop, ok, p`` with the votes for every candidate: ``p`` is the classifier's probability."""
    found = stored(votes(candidates(docs)).drop("match", "before"), "candidates")
    counted = found.where("kind is not null").groupBy("kind", *VOTES, *FEATURES).count().collect()  # bounded by votes and features
    weights = train(sorted((r["kind"], tuple(r[v] for v in VOTES), tuple(r[f] for f in FEATURES), r["count"]) for r in counted))
    return found.withColumn("p", probability(weights))


def spans(docs: DataFrame) -> DataFrame:
    """``row, doc_id, kind, start, stop, base, p`` for every accepted span, one row with a null kind for each text.

    Base spans are the valid matches of the four base kinds and stay. A candidate of another kind is accepted if the
    classifier gives it one half or more, whatever the regex labeler says; so is no invalid match of a base kind.
    """
    out = judged(docs)
    base = F.coalesce(F.col("kind").isin(*BASE) & F.col("ok"), F.lit(False))
    added = ~F.col("kind").isin(*BASE) & (F.col("p") >= 0.5)
    return out.where(F.col("kind").isNull() | base | added).select("row", "doc_id", "kind", "start", "stop", base.alias("base"), "p")


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans`` of ``doc_id, text``, a row for each row.

    ``n_added`` counts the spans of other than base kinds, ``n_spans`` all. Null and empty texts have no spans. A null doc_id is left out. Spans are listed as kind:start:end.
    """
    found = spans(docs.where(F.col("doc_id").isNotNull()))
    order = F.lit(None).cast("int")
    for i, kind in enumerate(KINDS):
        order = F.when(F.col("kind") == kind, i).otherwise(order)
    span = F.struct(order.alias("o"), "start", "stop", "kind", "base")
    texts = found.groupBy("row").agg(
        F.min("doc_id").alias("doc_id"),
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE],
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("all"),  # of one text
    )
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return texts.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(listed(F.filter("all", lambda s: s["base"])), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"), F.size(F.filter("all", lambda s: ~s["base"])).cast("long").alias("n_added"), F.size("all").cast("long").alias("n_spans"))
