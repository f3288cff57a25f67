"""Personal data by weak supervision.

Base kinds (email, ip, card, phone) have fixed patterns and checks. Beyond them, every run of non-blank characters with a digit
or an `@` is a candidate for a secret (a key, token, password or personal number). Labelling functions - shapes, a gazetteer of
prefixes, the words before, the mix of characters - vote on each candidate (1, 0 or -1). The counts of all vote patterns over the whole
corpus, a table of bounded size, go to expectation-maximisation, which estimates how reliable each labeller is; the resulting
soft labels train a logistic span classifier on votes and span features. Its dot product is a column expression, and
candidates that it accepts and that overlap no base span are added as kind `secret`. Only built-in functions run on executors, and
the registered query reads and matches every text once.

Edge cases: null and empty texts have no spans; a table without candidates adds nothing; repeated rows, and rows without an id, are judged
each; spans of one start are ordered by kind as listed; matches that fail their kind's check are dropped and not tried again; texts, runs and
numbers of matches of any size take time in proportion to them: patterns never go back over a run, and places come from running
sums in blocks; other columns are ignored. A secret of letters only is no candidate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

KINDS = ("email", "ip", "card", "phone", "secret")
#: The fixed patterns. Possessive quantifiers and the start conditions change no match: they only keep long runs linear.
#: A match starts where its run of characters starts, or right after the previous match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be worth trying.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
CANDIDATE = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D0-9@]*+[0-9@]|A[KS]IA)[^\x20\x09-\x0D]*+"
WORDS = r"(?<![A-Za-z])[A-Za-z]{2,}+[.,;:!?|]++[A-Za-z]{2}"
#: What may follow a candidate without being part of it.
AFTER = r"[\"')\]>},;:!?.#&%$*]"

SHAPE = r"^(AKIA[0-9A-Z]{16}|(?=[0-9]*[a-f])[0-9a-f]{16,}|(?=[0-9]*[A-F])[0-9A-F]{16,}|(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/=-]{20,}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})$"
NUMBER = r"^[#$]?[0-9]{1,9}([.,:/-][0-9]{1,4}){0,3}[%.)]?$"
PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "github_pat_", "sk-", "pk_live_", "sk_live_", "xoxb-", "xoxp-", "eyJ")
LINKS = r"(?i)^(https?://|www\.)"
BEFORE = r"(?i)(password|passwd|pwd|passphrase|token|secret|api[_ -]?key|access[_ -]?key|ssn|iban|passport|account)[\"' ]{0,3}[=:]?[\"' ]{0,3}$"
COUNTED = r"(?i)(page|chapter|section|version|figure|table|no\.|nr\.)\x20$"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, step, zero: int, block: int = 64, levels: int = 3) -> Column:
    """For each number of an array what `step` (plus or greatest) makes of zero and all numbers before it.

    Appending copies an array, so numbers are taken in blocks, the results of blocks in blocks of their own, and so on: copies are
    of `block` numbers, but for those of one array that is block^(levels - 1) times shorter.
    """
    state = "struct<at:int,out:array<int>>"

    def plain(part: Column) -> Column:
        start = F.struct(F.lit(zero).alias("at"), F.array().alias("out")).cast(state)
        return F.aggregate(part, start, lambda s, x: F.struct(step(s.at, x).alias("at"), F.array_append(s.out, s.at).alias("out")).cast(state))

    def blocks(v: Column) -> Column:
        last = F.greatest(F.ceil(F.size(v) / block).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: plain(F.slice(v, i * block + 1, F.lit(block))))

    def joined(parts: Column) -> Column:
        before = running(F.transform(parts, lambda p: p.at), step, zero, block, levels - 1)
        return F.flatten(F.zip_with(parts, before, lambda p, x: F.transform(p.out, lambda y: step(x, y))))

    return let(values, lambda v: plain(v).out) if levels == 1 else let(values, lambda v: let(blocks(v), joined))


def spans(text: Column, pattern: str, before: int = 0) -> Column:
    """All matches as array<struct<start,end,text,before>>, in code points; `before` characters of what precedes, if asked for."""
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    found = F.filter(found, lambda e: e.hit.isNotNull())

    def placed(hits: Column) -> Column:
        at = running(F.transform(hits, lambda e: F.length(e.gap) + F.length(e.hit)), lambda x, y: x + y, 0)
        return let(at, lambda p: F.transform(hits, lambda e, i: span(e, F.get(p, i) + F.length(e.gap))))

    def span(e: Column, start: Column) -> Column:
        head = F.when(F.length(e.gap) > before, F.right(e.gap, F.lit(before))).otherwise(e.gap) if before else F.lit("")
        return F.struct(start.alias("start"), (start + F.length(e.hit)).alias("end"), e.hit.alias("text"), head.alias("before"))

    return let(found, placed)


def clear(taken: Column, base: Column) -> Column:
    """Those of some spans (array<struct<start,kind,end>>) that overlap none of the base."""
    lowest = -(2**31) + 1
    events = F.sort_array(F.concat(F.transform(base, lambda b: F.struct(b.start.alias("s"), F.lit(-1).alias("kind"), b.end.alias("e"))), F.transform(taken, lambda t: F.struct(t.start.alias("s"), t.kind.alias("kind"), t.end.alias("e")))))

    def outside(all_: Column) -> Column:
        # The furthest end of a base span that starts no later, and the nearest start of one that starts later.
        ends = running(F.transform(all_, lambda x: F.when(x.kind < 0, x.e).otherwise(0)), F.greatest, 0)
        starts = running(F.transform(F.reverse(all_), lambda x: F.when(x.kind < 0, -x.s).otherwise(lowest)), F.greatest, lowest)
        free = lambda x, i, e, s: (x.kind >= 0) & (F.get(e, i) <= x.s) & (-F.get(s, F.size(all_) - 1 - i) >= x.e)
        kept = let(ends, lambda e: let(starts, lambda s: F.filter(all_, lambda x, i: free(x, i, e, s))))
        return F.transform(kept, lambda x: F.struct(x.s.alias("start"), x.kind.alias("kind"), x.e.alias("end")))

    return F.when((F.size(taken) == 0) | (F.size(base) == 0), taken).otherwise(let(events, outside))


def n_digits(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^0-9]", ""))


def luhn(x: Column) -> Column:
    """Whether the digits of x pass the Luhn check; call it for a bounded number of digits only."""
    d = F.reverse(F.regexp_replace(x, "[^0-9]", ""))

    def add(total: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


CHECKS = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x.rlike(r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"),
    "card": lambda x: F.when(n_digits(x).between(12, 19), luhn(x)).otherwise(False),
    "phone": lambda x: n_digits(x).between(9, 15),
}


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with text never null and, per base kind, an array of struct<start,kind,end> (kind by number)."""
    text = F.col("text")
    docs = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    none = F.array().cast("array<struct<start:int,end:int,text:string,before:string>>")
    digits = text.rlike("[0-9]")
    cols = []
    for kind, pattern in BASE.items():
        need = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
        need = need if kind == "email" else need & digits
        cols.append(F.when(need, spans(text, pattern)).otherwise(none).alias(kind))
    docs = docs.select("doc_id", "text", *cols)
    return docs.select("doc_id", "text", *(_checked(kind, i).alias(kind) for i, kind in enumerate(BASE)))


def _checked(kind: str, number: int) -> Column:
    """Spans of a base kind that pass its check."""
    passed = F.filter(kind, lambda s: CHECKS[kind](s.text))
    return F.transform(passed, lambda s: F.struct(s.start.alias("start"), F.lit(number).alias("kind"), s.end.alias("end")))


def candidates(text: Column) -> Column:
    """array<struct<start,end,core,before>> of candidates without the quotes, brackets and names around them."""
    none = F.array().cast("array<struct<start:int,end:int,text:string,before:string>>")
    found = F.when(text.rlike("[0-9@]|A[KS]IA"), spans(text, CANDIDATE, 24)).otherwise(none)

    def trim(s: Column) -> Column:
        lead = F.regexp_extract(s.text, r"^((?:[A-Za-z_-]{1,30}[=:])?[\"'(\[<{]*)", 1)
        core = F.regexp_replace(F.substring(s.text, F.length(lead) + 1, F.length(s.text)), f"(?<!{AFTER}){AFTER}++$", "")
        start = s.start + F.length(lead)
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("core"), F.concat(s.before, lead).alias("before"))

    return F.filter(F.transform(found, trim), lambda s: s.end > s.start)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def votes(core: Column, before: Column) -> dict[str, Column]:
    """Labelling functions: each says 1 (secret), -1 (not) or 0."""
    never = F.lit(False)
    letters = F.length(F.regexp_replace(core, "[^A-Za-z]", ""))
    prefix = never
    for p in PREFIXES:
        prefix = prefix | core.startswith(p)
    return {
        "shape": _vote(core.rlike(SHAPE), core.rlike(NUMBER)),
        "gazetteer": _vote(prefix, core.rlike(LINKS)),
        "context": _vote(before.rlike(BEFORE), before.rlike(COUNTED)),
        "mix": _vote((F.length(core) >= 16) & (n_digits(core) >= 4) & (letters >= 4), F.length(core) < 8),
        "words": _vote(never, core.rlike(WORDS) | core.rlike(r"[^\x00-\x7F]") | (n_digits(core) * 5 < F.length(core))),
    }


#: Span features besides the votes.
FEATURES = {
    "long": lambda core: F.length(core) >= 12,
    "longer": lambda core: F.length(core) >= 20,
    "digits": lambda core: n_digits(core) * 2 >= F.length(core),
    "upper": lambda core: core.rlike("^[A-Z0-9]+$"),
}
LABELLERS = ("shape", "gazetteer", "context", "mix", "words")


def described(found: Column) -> Column:
    """Candidates as array<struct<start,end,votes...,features...>>."""
    return F.transform(found, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), *(v.alias(k) for k, v in votes(s.core, s.before).items()), *(f(s.core).cast("int").alias(k) for k, f in FEATURES.items())))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, prior: float = 0.2) -> tuple[list[float], float, list[dict]]:
    """Expectation-maximisation over vote patterns with counts: per pattern P(secret), the share of secrets, and per labeller P(vote | class)."""
    labellers = range(len(patterns[0][0])) if patterns else range(0)
    soft = [1 / (1 + math.exp(-2 * sum(v))) for v, _ in patterns]
    share, tables = prior, []
    for _ in range(rounds):
        mass = [sum(q * n for q, (_, n) in zip(soft, patterns)), sum((1 - q) * n for q, (_, n) in zip(soft, patterns))]
        share = min(0.99, max(1e-6, (mass[0] + 1) / (sum(mass) + 2)))
        tables = []
        for k in labellers:
            count = {(y, v): 0.5 for y in (0, 1) for v in (-1, 0, 1)}
            for q, (vote, n) in zip(soft, patterns):
                count[1, vote[k]] += q * n
                count[0, vote[k]] += (1 - q) * n
            tables.append({key: c / (mass[1 - key[0]] + 1.5) for key, c in count.items()})
        soft = []
        for vote, _ in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(tables[k][1, vote[k]] / tables[k][0, vote[k]]) for k in labellers)
            soft.append(1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))))
    return soft, share, tables


def train_classifier(rows: list[tuple[list[float], float, int]], steps: int = 400, rate: float = 1.0, l2: float = 1e-3) -> list[float]:
    """Weights (the last is the bias) of a logistic regression on (features, soft label, count), by gradient steps with momentum."""
    if not rows:
        return []
    total, size = sum(n for _, _, n in rows), len(rows[0][0]) + 1
    # Counts enter by their square root: a frequent pattern must not drown rare ones.
    mass = sum(math.sqrt(n) for _, _, n in rows)
    w, speed = [0.0] * size, [0.0] * size
    for _ in range(steps if total else 0):
        grad = [l2 * x for x in w]
        for x, y, n in rows:
            z = sum(a * b for a, b in zip(w, x)) + w[-1]
            d = (1 / (1 + math.exp(-max(-35.0, min(35.0, z)))) - y) * math.sqrt(n) / mass
            for i, a in enumerate(x):
                grad[i] += d * a
            grad[-1] += d
        speed = [0.9 * s - rate * g for s, g in zip(speed, grad)]
        w = [a + s for a, s in zip(w, speed)]
    return w


def _encode(vote: tuple[int, ...], extra: tuple[int, ...]) -> list[float]:
    return [float(v == 1) for v in vote] + [float(v == -1) for v in vote] + [float(e) for e in extra]


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of struct<start,kind,end>, sorted), n_email, n_ip, n_card, n_phone and described candidates c of docs (doc_id, text)."""
    based = base_spans(docs)
    return based.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sort_array(F.concat(*BASE)).alias("base"), described(candidates(F.col("text"))).alias("c"))


def learn_classifier(found: DataFrame) -> list[float]:
    """The span classifier's weights, from the votes on all candidates of all prepared documents."""
    names = (*LABELLERS, *FEATURES)
    each = found.select(F.explode("c").alias("c"))
    counted = each.groupBy(*(F.col(f"c.{k}").alias(k) for k in names)).count().orderBy(*names).collect()  # at most 3^5 * 2^4 rows
    merged: dict[tuple[int, ...], int] = {}
    for r in counted:
        vote = tuple(r[k] for k in LABELLERS)
        merged[vote] = merged.get(vote, 0) + r["count"]
    patterns = sorted(merged.items())
    soft = dict(zip((p for p, _ in patterns), reliabilities(patterns)[0])) if patterns else {}
    rows = []
    for r in counted:
        vote = tuple(r[k] for k in LABELLERS)
        rows.append((_encode(vote, tuple(r[k] for k in FEATURES)), soft[vote], r["count"]))
    return train_classifier(rows)


def accepts(weights: list[float], c: Column, threshold: float) -> Column:
    """Whether the classifier takes a described candidate."""
    if not weights:
        return F.lit(False)
    values = [c[k] == 1 for k in LABELLERS] + [c[k] == -1 for k in LABELLERS] + [c[k] == 1 for k in FEATURES]
    z = F.lit(weights[-1])
    for w, v in zip(weights, values):
        z = z + F.when(v, F.lit(w)).otherwise(F.lit(0.0))
    return z >= math.log(threshold / (1 - threshold))


def add_secrets(found: DataFrame, weights: list[float], threshold: float = 0.8) -> DataFrame:
    """Prepared documents: doc_id, n_email, n_ip, n_card, n_phone, n_secret, base and found (base and secrets), sorted."""
    taken = F.transform(F.filter("c", lambda s: accepts(weights, s, threshold)), lambda s: F.struct(s.start.alias("start"), F.lit(len(BASE)).alias("kind"), s.end.alias("end")))
    counts = [f"n_{k}" for k in BASE]
    out = found.select("doc_id", *counts, "base", taken.alias("taken"))
    out = out.select("doc_id", *counts, "base", clear(F.col("taken"), F.col("base")).alias("more"))
    return out.select("doc_id", *counts, F.size("more").cast("long").alias("n_secret"), "base", F.sort_array(F.concat("base", "more")).alias("found"))


def find_pii(docs: DataFrame, weights: list[float] | None = None, threshold: float = 0.8) -> DataFrame:
    """The spans of docs (doc_id, text), see add_secrets; without weights, those learned from the same documents."""
    found = prepared(docs)
    if weights is None:
        found = cut(found)
        weights = learn_classifier(found)
    return add_secrets(found, weights, threshold)


def written(found: str) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(written("base"), 256).alias("base_sha256"), written("found").alias("spans"), "n_secret", F.size("found").cast("long").alias("n_spans"))
