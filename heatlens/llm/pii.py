"""Personal data: weak labelers vote on spans, expectation-maximisation weighs them.

Base spans (email, ip, card, phone) are found by pattern and check, leftmost and
non-overlapping for each kind, and always stay. Wider patterns give more candidates that do
not touch a base span: spelled-out mail addresses, phone numbers without a country code,
national numbers, and secrets, which may touch one. Four labelers look at each candidate, base spans included, and
vote for, against or abstain: its format, a gazetteer of codes and names, the words before it,
and its shape. Candidates are counted by kind and votes; on that table, of bounded size,
expectation-maximisation estimates how reliable each labeler is for each kind, and a logistic
regression on votes, kind and length learns to tell spans from the estimated labels. The
regression then decides about the candidates of every document.

Positions are code points, end exclusive. A null text counts as empty. Each row is worked
on by itself; its spans are one array, as long as the text has matches. Places come from
running sums over gaps and matches, so the time of a text with n matches grows with n log n.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from heatlens.llm.common import staged, text_of

# Base patterns and order of kinds. The look-behinds only keep the engine from
# starting again inside a run that has already failed; possessive repeats keep it from
# going back. Neither changes what is matched.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone", "national", "secret")
BASE_KINDS = KINDS[:4]

# Wider patterns: kind, a test that few texts pass, pattern. Values have no longest length:
# what is left of a longer one would stay in the text.
WIDER = (
    ("email", r"(?i)[(\[]\s?at\s?[)\]]", r"(?i)(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]++(?:(?:\.| ?[(\[] ?dot ?[)\]] ?)[A-Za-z0-9-]++)++"),
    ("phone", r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("national", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("secret", r"(?i)(?:password|passwd|secret|token|api_?key)[=:]|AKIA[0-9A-Z]{12}", r"(?i:password|passwd|secret|token|api_?key)[=:][^\s,;]{6,}+|AKIA[0-9A-Z]{12,}+"),
)

# What the labelers know.
CONTEXT_CHARS = 40
CUES = {
    "email": r"mail|contact|write to|correo|courriel|adresse|kontakt",
    "ip": r"\bip\b|host|server|address|login|from",
    "card": r"card|visa|mastercard|credit|payment|tarjeta|carte|karte",
    "phone": r"phone|tel|call|mobile|fax|ruf|teléfono|appel",
    "national": r"ssn|social security|national|passport|ausweis|dni",
    "secret": r"login|user|credential|aws|key|access",
}
AGAINST_CUES = r"version|licen[cs]e|section|page|isbn|chapter|order|invoice|article"
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "card": r"^(?:3[47]|4|5[1-5]|2[2-7]|6)",
    "phone": r"^\+(?:1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])",
    "secret": r"^AKIA|(?i)^(?:password|passwd)",
}
GAZETTEER_AGAINST = {
    "ip": r"^(?:0|127|255)\.",
    "email": r"(?i)@(?:localhost|invalid)\b",
    "national": r"^(?:000|666|9)",
    "phone": r"^\(?[01]",
}
VOTES = ("format", "gazetteer", "context", "shape")
ROUNDS = 50

SPAN = "struct<start:int,end:int,kind:string,base:boolean,value:string,before:string>"
# Texts are cut into pieces of so many characters before places in them are looked up.
PIECE = 4096


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, combine) -> Column:
    """The array of running combinations of ``values`` by an associative ``combine``. Each round
    joins entries twice as far apart as the one before, so n values take log2(n) rounds."""

    def step(acc: Column, stride: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= stride, combine(acc[i - stride], x)).otherwise(x))

    strides = F.array(*[F.lit(1 << k) for k in range(31)])
    return _let(values, lambda v: F.aggregate(F.filter(strides, lambda stride: stride < F.size(v)), v, step))


def _tail(text: Column) -> Column:
    return F.substring(text, -CONTEXT_CHARS, CONTEXT_CHARS)


def _matches(text: Column, test: Column, pattern: str, kind: str, base: bool) -> Column:
    """All matches with their places and what stands before them: gaps between matches and
    matches alternate, and running lengths and ends of them tell where a gap begins."""
    found = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")),
    )

    def spans(pairs: Column) -> Column:
        pieces = F.transform(
            pairs,
            lambda x: F.struct(
                (F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("pos"),
                _tail(F.concat(_tail(x["gap"]), F.coalesce(_tail(x["hit"]), F.lit("")))).alias("tail"),
            ),
        )
        running = _running(
            pieces,
            lambda x, y: F.struct((x["pos"] + y["pos"]).alias("pos"), _tail(F.concat(x["tail"], y["tail"])).alias("tail")),
        )
        begins = F.concat(F.array(F.struct(F.lit(0).alias("pos"), F.lit("").alias("tail"))), running)

        def span(x: Column, begin: Column) -> Column:
            start = begin["pos"] + F.length(x["gap"])
            return F.struct(
                start.alias("start"),
                (start + F.length(x["hit"])).alias("end"),
                F.lit(kind).alias("kind"),
                F.lit(base).alias("base"),
                x["hit"].alias("value"),
                F.lower(_tail(F.concat(begin["tail"], _tail(x["gap"])))).alias("before"),
            )

        return F.filter(F.zip_with(pairs, begins, span), lambda s: s["value"].isNotNull())

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(test, _let(found, spans)).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    email = _matches(text, F.contains(text, F.lit("@")), EMAIL, "email", True)
    ip = _matches(text, text.rlike(r"[0-9]\.[0-9]"), IP, "ip", True)
    card = _matches(text, text.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"), CARD, "card", True)
    phone = _matches(text, F.contains(text, F.lit("+")), PHONE, "phone", True)
    return F.concat(
        email,
        F.filter(ip, lambda s: s["value"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        F.filter(card, lambda s: F.length(_digits(s["value"])).between(16, 19) & F.call_function("luhn_check", _digits(s["value"]))),
        F.filter(phone, lambda s: F.length(_digits(s["value"])).between(8, 15)),
    )


def _wider_spans(text: Column) -> Column:
    return F.concat(*[_matches(text, text.rlike(test), pattern, kind, False) for kind, test, pattern in WIDER])


def _apart(base: Column, wider: Column) -> Column:
    """``base`` and those of ``wider`` that touch none of them, by start. A span touches a base span
    if one that begins no later ends after its start, or one that begins no earlier does so before its end."""

    def look(spans: Column) -> Column:
        reach = _running(F.transform(spans, lambda s: F.when(s["base"], s["end"]).otherwise(F.lit(0))), F.greatest)
        begins = F.transform(F.reverse(spans), lambda s: F.when(s["base"], s["start"]).otherwise(F.lit(2**31 - 1)))
        ahead = F.reverse(_running(begins, F.least))
        looked = F.zip_with(
            F.zip_with(spans, reach, lambda s, r: F.struct(s.alias("span"), r.alias("reach"))),
            ahead,
            lambda x, a: F.struct(x["span"].alias("span"), ((x["reach"] > x["span"]["start"]) | (a < x["span"]["end"])).alias("touches")),
        )
        # a long secret may hold what looks like a base span and is a secret all the same
        stays = F.filter(looked, lambda x: x["span"]["base"] | (x["span"]["kind"] == "secret") | ~x["touches"])
        return F.transform(stays, lambda x: x["span"])

    both = (F.size(base) > 0) & (F.size(wider) > 0)
    return F.when(both, _let(F.array_sort(F.concat(base, wider)), look)).otherwise(F.concat(base, wider))


def _by_kind(kind: Column, cases: dict[str, Column], other: Column) -> Column:
    out = other
    for name, case in cases.items():
        out = F.when(kind == name, case).otherwise(out)
    return out


def _voted(s: Column) -> Column:
    """A candidate with the vote of each labeler: 1 for, -1 against, 0 abstains."""
    kind, value, digits = s["kind"], s["value"], _digits(s["value"])
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    shape_digits = F.length(F.regexp_replace(digits, r"^(.)\1*$", "")) == 0
    for_it = _by_kind(kind, {k: value.rlike(p) for k, p in GAZETTEER.items()}, F.lit(False))
    against = _by_kind(kind, {k: value.rlike(p) for k, p in GAZETTEER_AGAINST.items()}, F.lit(False))
    cue = _by_kind(kind, {k: s["before"].rlike(p) for k, p in CUES.items()}, F.lit(False))
    return F.struct(
        kind.alias("kind"),
        s["start"].alias("start"),
        s["end"].alias("end"),
        s["base"].alias("base"),
        F.when(s["base"], yes).when(kind.isin("national", "secret"), none).otherwise(no).alias("format"),
        F.when(against, no).when(for_it, yes).otherwise(none).alias("gazetteer"),
        F.when(s["before"].rlike(AGAINST_CUES), no).when(cue, yes).otherwise(none).alias("context"),
        F.when(kind.isin("email", "secret"), F.when(value.rlike("[0-9]"), yes).otherwise(none))
        .when(shape_digits, no)
        .otherwise(yes)
        .alias("shape"),
        F.least(F.length(value) / 8, F.lit(4)).cast("int").alias("size"),
    )


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs[keep]`` and ``__spans``: every candidate with its votes."""
    text = F.col("__text")
    rows = docs.select(*keep, text_of().alias("__text"))
    rows = rows.withColumn("__base", base_spans(text)).withColumn("__wider", _wider_spans(text))
    return rows.select(*keep, F.transform(_apart(F.col("__base"), F.col("__wider")), _voted).alias("__spans"))


def estimate_labels(rows: list) -> np.ndarray:
    """For each (kind, votes, count) row the probability that its spans are personal data.
    Each kind has its own share of true spans and its own reliabilities, smoothed."""
    posterior = np.zeros(len(rows))
    for kind in {r.kind for r in rows}:
        at = [i for i, r in enumerate(rows) if r.kind == kind]
        votes = np.array([[r[v] for v in VOTES] for i, r in enumerate(rows) if i in set(at)])
        n = np.array([rows[i].n for i in at], float)
        p = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
        for _ in range(ROUNDS):
            share = (n @ p + 1) / (n.sum() + 2)
            odds = np.full(len(at), np.log(share / (1 - share)))
            for labeler, vote in itertools.product(range(len(VOTES)), (-1, 0, 1)):
                cast = votes[:, labeler] == vote
                # A labeler is taken to be right more often than not.
                prior = {1: (2.0, 0.5), 0: (1.0, 1.0), -1: (0.5, 2.0)}[vote]
                yes = ((n * p) @ cast + prior[0]) / (n @ p + 3.5)
                no = ((n * (1 - p)) @ cast + prior[1]) / (n @ (1 - p) + 3.5)
                odds += cast * np.log(yes / no)
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        posterior[at] = p
    return posterior


def _names(row) -> list[str]:
    return ["bias", f"kind {row.kind}", *(f"{v} {row[v]}" for v in VOTES), f"size {row.size}"]


def train_classifier(spans: DataFrame) -> dict[str, float]:
    """Weights of the span classifier, by feature. ``spans``: rows of voted candidates. Empty
    without candidates."""
    rows = spans.groupBy("kind", *VOTES, "size").agg(F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: tuple(map(str, r)))
    if not rows:
        return {}
    target, n = estimate_labels(rows), np.array([r.n for r in rows], float)
    names = sorted({x for r in rows for x in _names(r)})
    x = np.array([[float(name in _names(r)) for name in names] for r in rows])
    w = np.zeros(len(names))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (n * (p - target)) + w)
    return dict(zip(names, w.tolist()))


def _accepted(weights: dict[str, float]):
    def look(name: str, value: Column) -> Column:
        out = F.lit(0.0)
        for key, weight in weights.items():
            if key.startswith(name + " "):
                out = F.when(value.cast("string") == key[len(name) + 1 :], weight).otherwise(out)
        return out

    def accept(s: Column) -> Column:
        total = F.lit(weights.get("bias", -1.0))
        for name in ("kind", *VOTES, "size"):
            total = total + look(name, s[name])
        return s["base"] | (total >= 0)

    return accept


def find_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs[keep]`` and ``spans``: array of ``rank, kind, start, end, base`` in order of kind and start."""
    found = staged(candidates(docs, *keep), "pii-candidates")
    weights = train_classifier(found.select(F.explode("__spans").alias("s")).select("s.*"))
    ranked = lambda s: F.struct(
        F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int").alias("rank"),
        s["start"].alias("start"),
        s["end"].alias("end"),
        s["kind"].alias("kind"),
        s["base"].alias("base"),
    )
    return found.select(*keep, F.array_sort(F.transform(F.filter("__spans", _accepted(weights)), ranked)).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with a bracket for each of ``spans`` (by start) that begins after all before it have ended."""
    ends = F.concat(F.array(F.lit(0)), _running(F.transform(spans, lambda s: s["end"]), F.greatest))
    placed = F.zip_with(
        F.concat(spans, F.array(F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.lit(None).cast("string").alias("kind")))),
        ends,
        lambda s, pos: F.struct(pos.alias("pos"), s["start"].alias("start"), s["kind"].alias("kind")),
    )

    def kept(pieces: Column, start: Column, end: Column) -> Column:
        """The characters from ``start`` to ``end``; only pieces that hold some are walked through."""
        first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
        head = F.coalesce(F.get(pieces, first), F.lit(""))
        tail = F.substring(F.coalesce(F.get(pieces, last), F.lit("")), F.lit(1), end % PIECE)
        whole = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(first == last, F.substring(head, start % PIECE + 1, end - start)).otherwise(
            F.concat(F.substring(head, start % PIECE + 1, F.lit(PIECE)), whole, tail)
        )

    def parts(pieces: Column) -> Column:
        return F.transform(
            F.filter(placed, lambda x: x["start"] >= x["pos"]),
            lambda x: F.concat(kept(pieces, x["pos"], x["start"]), F.coalesce(F.concat(F.lit("["), x["kind"], F.lit("]")), F.lit(""))),
        )

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.array_join(_let(pieces, parts), "")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, such as ``[email]``; texts
    without spans, null ones too, stay as they are. Spans that overlap get one bracket. Texts are
    searched once: rows are written with their candidates and read again."""
    columns = [f"`{c}`" for c in docs.columns]
    rows = staged(candidates(docs, *columns), "pii-candidates")
    weights = train_classifier(rows.select(F.explode("__spans").alias("s")).select("s.*"))
    spans = F.array_sort(
        F.transform(
            F.filter("__spans", _accepted(weights)),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )
    masked = _let(spans, lambda found: F.when(F.size(found) > 0, _masked(F.col("text"), found)).otherwise(F.col("text")))
    return rows.select(*[masked.alias("text") if c == "`text`" else F.col(c) for c in columns])
