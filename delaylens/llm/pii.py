"""Personal data by weak supervision, in DataFrame functions alone.

Candidate spans come from strict patterns (always kept) and from looser ones. Labelers (format
checks, gazetteers, words around) vote on each candidate; expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is without any truth; the
posteriors then train a logistic span classifier, which decides on the loose candidates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.llm.tables import stored, table, texts

KINDS = ("email", "ip", "card", "phone")

# Possessive where nothing after could match otherwise, and begun only where a run begins:
# the same matches as the plain patterns, without backtracking over long runs.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[a-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[a-z]{2,24}+){1,4}",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}+:){7}+[0-9a-f]{1,4}+(?![0-9a-f:])",
    "card": r"(?<![0-9-])3[47][0-9]{2}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9-])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
#: Cheap signs without which a pattern can't match.
SIGN = {"email": r"@", "ip": r"\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LOOSE_SIGN = {"email": r"(?i)[(\[]at[)\]]", "ip": r":[0-9A-Fa-f]{1,4}:", "card": r"3[47][0-9]{2}[\x20-]", "phone": r"[0-9]{3}[.-][0-9]{4}"}
# Gazetteers and context words.
NAMED = {
    "email": r"(?i)(?:com|org|net|edu|gov|de|fr|es|eu|uk|info)$",
    "ip": r"^(?:10|127|172|192|[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+?\(?[1-9]",
}
CONTEXT = r"(?i)(?:mail|write|contact|call|phone|tel|fax|mobile|cell|card|visa|master|amex|credit|account|ip|host|server|address|from|reach)[^\p{L}]{0,4}$"
AGAINST = r"(?i)(?:token|version|section|isbn|sha|hash|key|id|no|v)[\x20:=\"'#.]*$"
EDGE = r"[\p{L}\p{N}]"
LABELERS = ("format", "gazetteer", "context", "against", "left", "right")
WINDOW = 16
#: The patterns of votes are few: kinds x strict or loose x two or three answers per labeler.
ROUNDS = 30


def _digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    at = F.sequence(F.lit(1), F.length(digits))
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(at, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.length(F.regexp_replace(x, "^0+", "")) <= 3  # noqa: E731  longer is more than 255
        small = lambda x: F.expr("true") & (F.right(x, F.lit(3)).cast("int") <= 255)
        return F.forall(F.split(match, r"\."), lambda x: part(x) & small(x))
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str, sign: str) -> Column:
    """All (start, end, value) matches of a pattern in code points, before any check.

    The text between matches comes from splitting at the pattern; adding lengths gives places.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)")
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(
            end.alias("at"),
            F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"),
        )

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    spans = F.aggregate(pairs, begin, step, lambda acc: acc["out"])
    return F.when(text.rlike(sign), spans).otherwise(none)


def _voted(text: Column, spans: Column, kind: str, strict: bool) -> Column:
    """The spans with the labelers' votes: 1 for, -1 against, 0 silent."""

    def judge(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - WINDOW + 1, F.lit(1)), F.least(s["start"], F.lit(WINDOW)))
        after = F.substring(text, s["end"] + 1, F.lit(1))
        last = F.right(before, F.lit(1))
        vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
        silent = F.lit(False)
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(strict).alias("strict"),
            F.array(
                vote(F.lit(strict), F.lit(not strict)),
                vote(s["value"].rlike(NAMED[kind]), ~s["value"].rlike(NAMED[kind])),
                vote(before.rlike(CONTEXT), silent),
                vote(silent, before.rlike(AGAINST)),
                vote(silent, last.rlike(EDGE)),
                vote(silent, after.rlike(EDGE)),
            ).alias("votes"),
        )

    return F.transform(spans, judge)


def candidates(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id and, per kind, the array of its candidate spans with votes; strict ones first.

    ``whole`` gives the document's row, all its columns in the struct ``row``, in place of doc_id.
    """
    d = texts(docs)
    if whole:
        d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    text, own = F.col("text"), d.columns[0]
    found = d.select(own, "text", *[
        F.filter(_spans(text, k, STRICT[k], SIGN[k]), lambda s: _valid(k, s["value"])).alias(f"strict_{k}") for k in KINDS
    ], *[_spans(text, k, LOOSE[k], LOOSE_SIGN[k]).alias(f"loose_{k}") for k in KINDS])

    def apart(k: str) -> Column:
        """Loose spans that touch no strict span of any kind."""
        every = F.concat(*[F.col(f"strict_{x}") for x in KINDS])
        return F.filter(f"loose_{k}", lambda s: ~F.exists(every, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    return found.select(own, *[
        F.concat(_voted(text, F.col(f"strict_{k}"), k, True), _voted(text, apart(k), k, False)).alias(k) for k in KINDS
    ])


def _patterns(found: DataFrame) -> list:
    """How often each pattern of votes occurs, by kind: a bounded table."""
    rows = None
    for k in KINDS:
        one = found.select(F.explode(k).alias("s")).select(F.lit(k).alias("kind"), "s.strict", "s.votes")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("kind", "strict", "votes").agg(F.count("*").alias("n")).orderBy("kind", "strict", "votes").collect()


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: posterior of each pattern, and each labeler's P(vote | class)."""
    classes = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)  # pattern x labeler x answer
    post = np.clip(0.5 + 0.2 * votes.sum(1), 0.05, 0.95)
    for _ in range(rounds):
        weight = np.stack([n * (1 - post), n * post])
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        answer = (np.einsum("cp,pla->cla", weight, classes) + 0.5) / (weight.sum(1)[:, None, None] + 1.5)
        log = np.log(prior)[:, None] + np.einsum("pla,cla->cp", classes, np.log(answer))
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return post, answer


def train(patterns: list) -> dict[str, list[float]]:
    """A logistic classifier per kind, from the posteriors of its vote patterns.

    Weights are the bias and one per labeler, fitted by Newton steps with a ridge. A kind
    without candidates has a classifier that never fires.
    """
    out = {}
    for kind in KINDS:
        rows = [p for p in patterns if p.kind == kind]
        if not rows:
            out[kind] = [-1.0] + [0.0] * len(LABELERS)
            continue
        votes = np.array([p.votes for p in rows], float)
        n = np.array([p.n for p in rows], float)
        post, _ = reliabilities(votes, n)
        x = np.hstack([np.ones((len(rows), 1)), votes])
        w = np.zeros(x.shape[1])
        ridge = np.eye(len(w)) * 0.1
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (n * (post - p)) - ridge @ w
            w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, grad)
        out[kind] = [round(float(v), 9) for v in w]
    return out


def _chosen(found: DataFrame, weights: dict[str, list[float]]) -> DataFrame:
    """Per kind ``all_<kind>``: strict spans, and loose ones that the classifier takes; by start."""

    def take(k: str) -> Column:
        bias, *w = weights[k]
        score = lambda s: sum((s["votes"][i] * F.lit(v) for i, v in enumerate(w)), F.lit(bias))
        kept = F.filter(k, lambda s: s["strict"] | (score(s) > 0))
        return F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["strict"].alias("strict"))))

    return found.select(found.columns[0], *[take(k).alias(f"all_{k}") for k in KINDS])


def _joined(kind_spans: list[tuple[str, Column]]) -> Column:
    named = [F.transform(c, lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"])) for k, c in kind_spans]
    return F.array_join(F.concat(*named), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the strict spans, and all spans.

    Places count code points, ends are exclusive. Null and empty texts have no span: counts 0,
    the digest of an empty string, empty spans. Repeated rows each give a row; an empty table
    gives an empty result. Texts of any length are searched whole.
    """
    found = stored(candidates(docs), "spans")
    chosen = _chosen(found, train(_patterns(found)))
    strict = {k: F.filter(f"all_{k}", lambda s: s["strict"]) for k in KINDS}
    return chosen.select(
        "doc_id",
        *[F.size(strict[k]).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(list(strict.items())), 256).alias("base_sha256"),
        _joined([(k, F.col(f"all_{k}")) for k in KINDS]).alias("spans"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets, all columns kept.

    Spans of different kinds that overlap are masked as one, under the first one's kind. A row is
    masked by its own spans, found in the same pass, so null and repeated ids and columns of any
    name are no matter. The votes are counted in a pass of their own before. Null texts stay null.
    """
    weights = train(_patterns(stored(candidates(docs), "spans")))
    chosen = _chosen(candidates(docs, whole=True), weights)
    every = F.array_sort(F.concat(*[
        F.transform(f"all_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind"))) for k in KINDS
    ]))
    hit = chosen.select("row", every.alias("spans"))
    text = F.col("row")["text"].cast("string")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        new = F.concat(acc["out"], gap, F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"),
        )

    clean = F.aggregate("spans", begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    masked_text = F.when(F.size("spans") > 0, clean).otherwise(text).alias("text")
    return hit.select(*[masked_text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


SQL = {}
QUERIES = {"op7_pii": op7_pii}
