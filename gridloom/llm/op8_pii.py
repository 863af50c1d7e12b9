"""Personal data by weak supervision: regex, gazetteer and context labelers vote, EM weighs them, a span classifier decides.

Base spans (kinds email, ip, card, phone) come from fixed patterns and checks and always stay. Further candidates
(written-out e-mail addresses, phone numbers without a plus, identity numbers, bank accounts, keys and passwords) are
each judged by three labelers, each voting 1, -1 or 0 (abstains):
  regex      the strict form of the kind: digits, lengths and check sums that such data has, or lacks (-1);
  gazetteer  the value begins or ends with, or holds, an entry of the kind's list (gazetteers.py), or none (0);
  context    a cue word for personal data or a given name, or one for order numbers, versions and the like (-1), stands
             in the CONTEXT_CHARS characters before it that follow the last match of its kind.
Base spans get votes too, so labelers are judged on them as well. A candidate that overlaps a span of an earlier kind is
none. The matches of all documents are found in one pass over the texts and written, a row a document; what follows works
on rows of matches and shuffles nothing else. The votes are counted by (kind, votes, features): a table bounded by the product of a few small
domains, not by the data. On it, EM over the latent class estimates each labeler's reliability for each kind
(Laplace-smoothed naive Bayes), and a logistic span classifier over kind, votes and length is fitted to the posteriors,
weighted by the counts. The classifier is a linear expression over the written votes. All expressions are built-in JVM
functions.

A text takes no more than linear time: a run that can't start a match isn't tried from its middle (the look-behind),
nothing is given back after runs that can't overlap what follows (possessive), and positions are running sums over the
rows of its matches.

Cases: a null or empty text has no spans (zero counts, digest of nothing, empty string); ties start at one place
and go by kind; repeated rows give repeated results; with no candidates at all the labelers keep their priors.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import gazetteers as lists
from gridloom.llm.common import table, text_only

BASE = ("email", "ip", "card", "phone")
EXTRA = ("email_written", "phone_local", "id_number", "iban", "secret")
KINDS = BASE + EXTRA
CONTEXT_CHARS = 24
EM_ROUNDS = 30
ACCEPT = 0.5
#: What each labeler is taken to have voted before it is seen, by class: -1, 0 and 1 of ten spans.
PRIOR_COUNTS = np.array([[3.0, 4, 3], [1, 3, 6]])


def _either(words, escape: bool = True) -> str:
    special = set("\\.[]{}()*+-?^$|")
    return "|".join("".join(f"\\{c}" if escape and c in special else c for c in w) for w in words)


# Fixed patterns. \G (the end of the last match) keeps a look-behind from hiding a match that starts there.
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERN = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_written": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?[(\[]at[)\]]\x20?{_DOMAIN}++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?){_DOMAIN}++)++",
    "phone_local": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": rf"(?:(?<![A-Za-z0-9_-])(?:{_either(lists.KEY_PREFIXES)})[A-Za-z0-9_.+/-]{{12,}}+|(?i:{_either(lists.SECRET_NAMES)})[\x22\x27]?\x20?[=:]\x20?[\x22\x27]?[^\x20\x09-\x0D\x22\x27]{{6,}}+|-----BEGIN\x20[A-Z\x20]{{0,24}}PRIVATE\x20KEY-----)",
}
# A text that fails its gate can't hold the kind; the costlier pattern isn't tried.
GATE = {
    "email": "contains(text, '@')",
    "ip": r"text RLIKE '[0-9]\\.[0-9]'",
    "card": r"text RLIKE '(?:[0-9][\\x20-]?){13}[0-9]'",
    "phone": "contains(text, '+')",
    "email_written": r"text RLIKE '[(\\[]at[)\\]]'",
    "phone_local": r"text RLIKE '[0-9]{3}[\\x20.-][0-9]{4}'",
    "id_number": r"text RLIKE '[0-9]{3}-[0-9]{2}-[0-9]{4}'",
    "iban": r"text RLIKE '[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]{4}'",
    "secret": f"text RLIKE '{_either([x for x in lists.KEY_PREFIXES], escape=False)}|PRIVATE' OR text RLIKE '[=:]' AND lower(text) RLIKE '{_either(lists.SECRET_NAMES, escape=False)}'",
}
_DIGITS = r"regexp_replace(x.m, '[^0-9]', '')"
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (t, i) -> t + CASE WHEN i % 2 = 1 THEN cast(substring({_DIGITS}, -i, 1) AS int)"
    f" ELSE CAST(substring('0246813579', cast(substring({_DIGITS}, -i, 1) AS int) + 1, 1) AS int) END) % 10 = 0"
)
_PASSES = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND cast(substring(concat('000', ltrim('0', p)), -3) AS int) <= 255)",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}
# The remainder of a bank account number, its first four characters moved to the end and letters read as 10 to 35.
_COMPACT = "replace(x.m, ' ', '')"
_MOD97 = f"aggregate(split(concat(substring({_COMPACT}, 5), substring({_COMPACT}, 1, 4)), ''), 0, (z, c) -> CASE WHEN c = '' THEN z WHEN c >= 'A' THEN (z * 100 + ascii(c) - 55) % 97 ELSE (z * 10 + cast(c AS int)) % 97 END)"
_IBAN_LENGTH = "CASE substring(x.m, 1, 2) " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in lists.IBAN_LENGTHS.items()) + " ELSE 0 END"


def _rlike(pattern: str, of: str = "x.m") -> str:
    return f"{of} RLIKE {_sql(pattern)}"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_MAIL = rf"(?i)(?:@|[)\]\x20.])(?:{_either(lists.MAIL_PROVIDERS)})(?:\.|\x20?[(\[]dot)|(?:\.|[)\]]\x20?)(?:{_either(lists.TOP_LEVEL)})$"
# The strict form of each kind (vote 1, else -1), and its list (vote 1, else 0), on the span x.
STRICT = {
    "email": _rlike(r"^[A-Za-z0-9][^@]*@.*\.[A-Za-z]{2,}$") + " AND NOT contains(x.m, '..')",
    "ip": "forall(split(x.m, '[.]'), p -> p = '0' OR NOT startswith(p, '0'))",
    "card": _rlike("^[3-6]") + f" AND length({_DIGITS}) BETWEEN 14 AND 16",
    "phone": _rlike(r"^\+[1-9]"),
    "email_written": _rlike(r"[A-Za-z]{2,}$"),
    "phone_local": _rlike(r"^\(?[2-9][0-8][0-9]\)?[\x20.-][2-9]"),
    "id_number": _rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"),
    "iban": f"{_MOD97} = 1",
    "secret": _rlike(r"PRIVATE|[0-9]") + " AND " + _rlike(r"[A-Za-z]"),
}
LISTED = {
    "email": _rlike(_MAIL),
    "ip": _rlike(rf"^(?:{_either(lists.HOST_PARTS)})\."),
    "card": _rlike(rf"^(?:{_either(lists.CARD_PREFIXES)})", f"{_DIGITS}"),
    "phone": _rlike(rf"^\+(?:{_either(lists.CALLING_CODES)}|(?:{_either(lists.CALLING_ZONES)})[0-9])"),
    "email_written": _rlike(_MAIL),
    "phone_local": "NOT " + _rlike(rf"^\(?(?:{_either(lists.SERVICE_AREAS)})"),
    "id_number": _rlike(r"^[0-7]"),
    "iban": f"length({_COMPACT}) = {_IBAN_LENGTH}",
    "secret": _rlike(rf"^(?:{_either(lists.KEY_PREFIXES)})|^(?i:{_either(lists.SECRET_NAMES)})|PRIVATE"),
}
_CUE = rf"(?i:{_either(lists.CUES)})|\b(?:{_either(lists.GIVEN_NAMES)})\b"
_COUNTER = rf"(?i:{_either(lists.COUNTER_CUES)})"


def _matches(kind: str) -> str:
    """SQL for the kind's matches in text: (kind, number, characters before it since the last match, its own characters, value,
    context). Splitting by the pattern gives what lies between its matches."""
    p = _sql(PATTERN[kind])
    pairs = f"filter(zip_with(regexp_extract_all(text, {p}, 0), split(text, {p}, -1), (m, g) -> struct(m, g)), x -> x.m IS NOT NULL)"
    value = f"struct({KINDS.index(kind)} AS k, i AS i, length(x.g) AS gap, length(x.m) AS own, x.m AS m, right(x.g, {CONTEXT_CHARS}) AS c)"
    none = "cast(array() AS array<struct<k:int,i:int,gap:int,own:int,m:string,c:string>>)"
    return f"CASE WHEN {GATE[kind]} THEN transform({pairs}, (x, i) -> {value}) ELSE {none} END"


def matches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, matches) of every row of docs, all kinds; row tells the rows apart once this is written."""
    found = ", ".join(_matches(k) for k in KINDS)
    return text_only(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.expr(f"concat({found})").alias("matches"))


def _votes() -> list[Column]:
    """A span's votes: vr, vg, vc in -1..1 and nb, its length's bucket."""
    pick = lambda tests, yes, no: "CASE k " + " ".join(f"WHEN {i} THEN CASE WHEN {tests[k].replace('x.m', 'm')} THEN {yes} ELSE {no} END" for i, k in enumerate(KINDS)) + " END"
    context = f"CASE WHEN {_rlike(_CUE, 'c')} THEN 1 WHEN {_rlike(_COUNTER, 'c')} THEN -1 ELSE 0 END"
    return [F.expr(sql).alias(name) for name, sql in (("vr", pick(STRICT, 1, -1)), ("vg", pick(LISTED, 1, 0)), ("vc", context), ("nb", "least(9, cast(length(m) / 4 AS int))"))]


def candidates(found: DataFrame) -> DataFrame:
    """(row, doc_id, s, e, k, vr, vg, vc, nb) from matches(), written: base spans, and further candidates that overlap no span
    of an earlier kind; code points, end exclusive. Spans by start and candidates by end in one order, a candidate overlaps a
    span that begins before its end just if the greatest end so far lies behind its start."""
    rows = found.select("row", "doc_id", F.explode("matches").alias("x")).select("row", "doc_id", "x.*")
    along = Window.partitionBy("row", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("e", F.sum(F.col("gap") + F.col("own")).over(along).cast("int")).withColumn("s", F.col("e") - F.col("own"))
    passes = "CASE k " + " ".join(f"WHEN {i} THEN {_PASSES[k].replace('x.m', 'm')}" for i, k in enumerate(BASE)) + " ELSE true END"
    events = placed.where(passes).withColumn("asks", F.explode(F.expr(f"CASE WHEN k < {len(BASE)} THEN array(0) ELSE array(0, 1) END")))
    before = Window.partitionBy("row").orderBy(F.expr("CASE WHEN asks = 1 THEN e ELSE s END"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    far = F.coalesce(*[F.when(F.col("k") == rank, F.max(F.when((F.col("asks") == 0) & (F.col("k") < rank), F.col("e"))).over(before)) for rank in range(len(BASE), len(KINDS))], F.lit(0))
    stays = events.withColumn("far", far).where(f"asks = 0 AND k < {len(BASE)} OR asks = 1 AND far <= s")
    return stays.select("row", "doc_id", "s", "e", "k", *_votes())


def count_votes(spans: DataFrame) -> DataFrame:
    """How often each (kind, votes, length bucket) occurs in all documents: at most 9 * 27 * 10 rows."""
    return spans.groupBy("k", "vr", "vg", "vc", "nb").count()


class SpanModel:
    """EM over vote counts, then a logistic classifier on its posteriors."""

    def __init__(self, rows: list[tuple[int, int, int, int, int, int]]):
        table = np.array(rows, dtype=np.int64).reshape(-1, 6)
        kind, votes, bucket, weight = table[:, 0], table[:, 1:4], table[:, 4], table[:, 5].astype(float)
        #: P(vote | class) by kind, labeler, class, vote + 1; priors favour a labeler that tells the truth
        self.reliability = np.tile(PRIOR_COUNTS / 10, (len(KINDS), 3, 1, 1))
        self.prior = np.full(len(KINDS), 0.5)
        posterior = self._posterior(kind, votes)
        for _ in range(EM_ROUNDS):
            for k in range(len(KINDS)):
                of = kind == k
                mass = weight[of].sum()
                self.prior[k] = (np.sum(weight[of] * posterior[of]) + 2) / (mass + 4)
                for lab in range(3):
                    for c in (0, 1):
                        p = posterior[of] if c else 1 - posterior[of]
                        n = np.array([np.sum(weight[of] * p * (votes[of, lab] == v)) for v in (-1, 0, 1)]) + PRIOR_COUNTS[c]
                        self.reliability[k, lab, c] = n / n.sum()
            posterior = self._posterior(kind, votes)
        posterior = np.where(kind < len(BASE), 1.0, posterior)  # base spans are certain
        x = self._features(kind, votes, bucket)
        total = max(1.0, weight.sum())
        self.weights = np.zeros(x.shape[1])
        for _ in range(400):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            self.weights -= 0.5 * (x.T @ (weight / total * (p - posterior)) + 1e-4 * self.weights)

    def _posterior(self, kind, votes):
        one, zero = np.log(self.prior[kind]), np.log1p(-self.prior[kind])
        for lab in range(3):
            one = one + np.log(self.reliability[kind, lab, 1, votes[:, lab] + 1])
            zero = zero + np.log(self.reliability[kind, lab, 0, votes[:, lab] + 1])
        return 1 / (1 + np.exp(np.clip(zero - one, -30, 30)))

    @staticmethod
    def _features(kind, votes, bucket):
        return np.column_stack([kind[:, None] == np.arange(len(KINDS)), votes, bucket[:, None] == np.arange(10)]).astype(float)

    def accepts(self) -> str:
        """SQL: whether the classifier takes a span."""
        w = [f"{v!r}D" for v in self.weights.tolist()]
        case = lambda field, values: f"CASE {field} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
        n = len(KINDS)
        score = f"{case('k', w[:n])} + {w[n]} * vr + {w[n + 1]} * vg + {w[n + 2]} * vc + {case('nb', w[n + 3 :])}"
        return f"({score} >= {math.log(ACCEPT / (1 - ACCEPT))!r}D)"


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')")


def find_personal_data(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans): n_spans counts all spans; fits the labelers on
    all of docs if no model is given."""
    found = table(matches(docs))
    voted = table(candidates(found))
    if model is None:
        model = SpanModel([tuple(r) for r in count_votes(voted).collect()])  # bounded by the vote domains
    kept = voted.where(f"k < {len(BASE)} OR {model.accepts()}").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "k", "e"))).alias("spans"))
    every = found.select("row", "doc_id").join(kept, "row", "left").withColumn("spans", F.expr("coalesce(spans, cast(array() AS array<struct<s:int,k:int,e:int>>))"))
    out = every.withColumn("base", F.expr(f"filter(spans, x -> x.k < {len(BASE)})"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) AS long)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return out.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
