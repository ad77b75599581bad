"""Personal data by bootstrapped contextual extraction.

Every text is scanned for base spans (email, ip, card, phone) by rules, and for secrets: values of SECRET_LENGTH letters
and digits or more that are given to a name like "token" or "api_key", and keys of known forms. They are the seeds and are
always reported. The same scan takes whatever may stand in the place of a pattern as a look-alike (any run of LEAST_DIGITS digits or more,
however separated; an address with its "at" or "dot" written out; groups of hexadecimal digits with colons; runs of
SECRET_LENGTH mixed letters and digits), once for each kind that its digits allow, so that the pattern decides on the kind, and, for seeds and look-alikes both, the
lexical patterns they stand in: the two words before, what is joined to the front, the words on either side, all within
80 characters, each word by its last 24. Spark then scores the graph of
patterns and instances in rounds, until one accepts nothing new. A pattern of `support` known instances is as good as
their share of what speaks for or against it: known instances of its kind, those of other kinds, and the different
ordinary words that stand in its place (`against`). Unlabelled look-alikes speak neither way, however many they are. An
instance is as good as its patterns taken together; what reaches `accept` becomes known and is added to the spans.

The scan leaves one small row per document and the graph holds a row per pattern and instance, counted before it is
shuffled. Texts are read again, and not shuffled, in each round that brings patterns whose ordinary words are not yet
counted: those with `support` that some look-alike stands in. They grow with the corpus and stay in tables; tasks get a
filter of them of 8 MB at most.

A run of more than 19 digits is several numbers: every few neighbouring words of it are a look-alike. What holds too
few digits for its kind (card 12 to 19, phone LEAST_DIGITS to 15), is joined to letters or digits on
either side, or spells digits as words is never a look-alike. Of accepted look-alikes that overlap, the best stays.

A null or empty text has no spans. Rows are told apart by doc_id and text, so repeated rows get equal results and null
ids work. Spans are ordered by start, then kind, then end. An empty table has an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import among, bloom
from .common import mapped, written

KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4
SUPPORT, PATTERN_FROM, ACCEPT = 3.0, 0.6, 0.8
#: Fewer digits than this are no identifier: what stands so in a pattern's place speaks against it.
LEAST_DIGITS = 7
#: Shorter values are no secret.
SECRET_LENGTH = 20

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A run of digits can only match from its first digit, so these cost what the text is long.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Look-alikes. A run of digits with up to three signs or spaces between two of them, or a written-out dot.
_RUN = re.compile(r"(?<![A-Za-z0-9])(?:\+ ?)?\(?[0-9](?:(?:(?:[^\S\r\n]|[()./:_+*#\u2010-\u2015-]){0,3}|\s?[(\[]?[dD][oO][tT][)\]]?\s?)[0-9])++(?![A-Za-z0-9])")
_HEX = re.compile(r"(?<![\w:.])(?=[0-9a-fA-F:]*:[0-9a-fA-F]*:)[0-9a-fA-F:]{3,39}+(?:(?<=:)[0-9]{1,3}(?:\.[0-9]{1,3}){3})?(?![\w:])")
_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])(?:\s?(?:@|[(\[{<]\s?(?:[aA][tT]|@)\s?[)\]}>])\s?|\s[aA][tT]\s)(?=[A-Za-z0-9-])")
_DOT = r"(?:\.|\s?[(\[{<]\s?(?:[dD][oO][tT]|\.)\s?[)\]}>]\s?|\s[dD][oO][tT]\s)"
_BEHIND = re.compile(rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*+")
_AHEAD = re.compile(rf"[A-Za-z0-9._%+-]++(?:(?:\s?[(\[{{<][dD][oO][tT][)\]}}>]\s?|\s[dD][oO][tT]\s)[A-Za-z0-9._%+-]++)*+$")
_BEFORE = re.compile(r"(\S*)\s+(\S*)\s+(\S*)$")
_AFTER = re.compile(r"\S*\s*(\S*)")
_NUMBER = re.compile("[0-9]+")
_GIVEN = re.compile(rf"""[=:]\s{{0,3}}["']?([A-Za-z0-9+/_.~-]{{{SECRET_LENGTH},}}=*)""")
_NAME = re.compile(r"""([A-Za-z_-]{2,32})["']?\s{0,3}$""")
_SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "secretkey", "accesskey", "privatekey", "authkey", "credential", "credentials")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*)(?![A-Za-z0-9])")
_KEY_STARTS = ("AKIA", "gh", "xox", "eyJ")
_LONG = re.compile(rf"(?<![A-Za-z0-9+/_=.@-])[A-Za-z0-9+/_-]{{{SECRET_LENGTH},128}}+={{0,2}}(?![A-Za-z0-9+/_=@-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, leftmost, not overlapping, found from its @."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found)


def mixed(value: str) -> bool:
    """Letters and digits, of many kinds: no word, number or line of signs."""
    return any(c in "0123456789" for c in value) and any(c.isalpha() for c in value) and len(set(value)) >= 8


def secrets(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Secrets that are told by a name or a known form and do not overlap base spans, sorted, none over another."""
    found = []
    if "=" in text or ":" in text:
        for m in _GIVEN.finditer(text):
            name = _NAME.search(text[max(0, m.start() - 40) : m.start()])
            if name and name[1].lower().replace("_", "").replace("-", "").endswith(_SECRET_NAMES) and mixed(m[1]):
                found.append((m.start(1), SECRET, m.end(1)))
    if any(k in text for k in _KEY_STARTS):
        found += [(m.start(), SECRET, m.end()) for m in _KEY.finditer(text)]
    return apart(found, base)


def apart(found: list[tuple[int, int, int]], others: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of found, sorted, that overlap none of the others and no earlier one."""
    out, end, i = [], 0, 0
    taken = sorted((a, b) for a, _, b in others)
    for a, k, b in sorted(found):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= end and not (i < len(taken) and taken[i][0] < b):
            out.append((a, k, b))
            end = b
    return out


def spelled(text: str) -> list[tuple[int, int]]:
    """Addresses with "at" or "dot" written out, or without a dot, found from their "at"."""
    found, end = [], 0
    for m in _AT.finditer(text):
        behind = _BEHIND.match(text, m.end())
        low = max(end, m.start() - 80)
        # not from within a word
        while low > end and not text[low - 1].isspace():
            low -= 1
        start = next((low + k.start() for k in _AHEAD.finditer(text[low : m.start()])), None)
        if start is None or m[0].strip().lower() == "at" and not re.search(_DOT, behind[0]):
            continue
        end = behind.end()
        found.append((start, end))
    return found


def kinds_of(run: str) -> list[int]:
    """The kinds that a run of digits may be of."""
    n = sum(c in "0123456789" for c in run)
    groups = re.findall("[0-9]+", run)
    ip = len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)
    return [1] * ip + [2] * (12 <= n <= 19) + [3] * (LEAST_DIGITS <= n <= 15)


def runs(text: str, start: int, end: int, most: int = 19) -> list[tuple[int, int]]:
    """A run of digits; one of more than `most` is several numbers: all of its neighbouring words of `most` at most."""
    if sum(c in "0123456789" for c in text[start:end]) <= most:
        return [(start, end)]
    ws = [(m.start(), m.end(), sum(c in "0123456789" for c in m[0])) for m in re.compile(r"\S+").finditer(text, start, end)]
    out = []
    for i, (a, _, _) in enumerate(ws):
        n = 0
        for j in range(i, len(ws)):
            _, b, k = ws[j]
            n += k
            if n > most or b - a > 80:
                break
            if n >= LEAST_DIGITS and k:
                out.append((a, b))
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Look-alikes that do not overlap base spans, sorted; one of digits once for each kind that it may be of."""
    found = [(a, 0, b) for a, b in spelled(text)] if "@" in text or _AT.search(text) else []
    if ":" in text:
        found += [(m.start(), 1, m.end()) for m in _HEX.finditer(text) if m[0].count(":") > 1 and re.search("[0-9a-fA-F]", m[0]) and (m[0].count(":") > 3 or "::" in m[0])]
    if _DIGIT.search(text):
        edges = sorted((a, b) for a, _, b in base)
        for m in _RUN.finditer(text):
            # a run beside a base span is cut there
            a, parts = m.start(), []
            for x, y in edges[bisect_left(edges, (a - 200, 0)) :] if edges else []:
                if x >= m.end():
                    break
                if y > a:
                    parts.append((a, x))
                    a = y
            for a, b in [*parts, (a, m.end())]:
                if n := _RUN.search(text, a, b):
                    found += [(x, k, y) for x, y in runs(text, n.start(), n.end()) for k in kinds_of(text[x:y])]
    found += [(m.start(), SECRET, m.end()) for m in _LONG.finditer(text) if mixed(m[0])]
    out, taken = [], sorted((a, b) for a, _, b in base)
    i = 0
    for a, k, b in sorted(found):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if not (i < len(taken) and taken[i][0] < b):
            out.append((a, k, b))
    return out


def patterns(text: str, start: int, end: int, reach: int = 80) -> list[str]:
    """The lexical patterns around a span; numbers count as one number, case does not count."""
    tidy = lambda w: _NUMBER.sub("0", w.lower())[-24:]
    before = (" x " * 2 + text[max(0, start - reach) : start]) if start < reach else text[start - reach : start]
    m = _BEFORE.search(before)
    far, near, front = map(tidy, m.groups()) if m else ("", "", tidy(before))
    n = _AFTER.match(text, end, min(len(text), end + reach))
    after = tidy(n[1]) if n else ""
    return [f"2:{far} {near}", f"s:{near} _ {after}"] + ([f"j:{front}"] if front else [f"1:{near}"])


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode()) - (1 << 63)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_EDGE = pa.struct([("pattern", pa.string()), ("value", pa.int64()), ("kind", pa.int32()), ("seed", pa.bool_())])
_LOOK = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.int64())])
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, text_hash, base spans, their digest, secrets, look-alikes, and the edges of the graph."""

    def work(batches):
        for batch in batches:
            out = {k: [] for k in ("text_hash", "base", "sha", "secrets", "looks", "edges")}
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                told = secrets(text, base)
                looks, edges, noted = loose_spans(text, base + told), [], []
                for seed, spans in ((True, base + told), (False, looks)):
                    for a, k, b in spans:
                        value = _hash(f"{KINDS[k]} {text[a:b].lower()}")
                        if not seed:
                            noted.append({"start": a, "kind": k, "end": b, "value": value})
                        edges += [{"pattern": p, "value": value, "kind": k, "seed": seed} for p in patterns(text, a, b)]
                out["text_hash"].append(_hash(text))
                out["base"].append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                out["secrets"].append([{"start": a, "kind": k, "end": b} for a, k, b in told])
                out["sha"].append(hashlib.sha256(joined(base).encode()).digest())
                out["looks"].append(noted)
                out["edges"].append(edges)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out["text_hash"], pa.int64()), pa.array(out["base"], pa.list_(_SPAN)), pa.array(out["sha"], pa.binary()), pa.array(out["secrets"], pa.list_(_SPAN)), pa.array(out["looks"], pa.list_(_LOOK)), pa.array(out["edges"], pa.list_(_EDGE))],
                ["doc_id", "text_hash", "base", "base_sha", "secrets", "looks", "edges"],
            )

    schema = f"doc_id long, text_hash long, base {_SPANS}, base_sha binary, secrets {_SPANS}, looks array<struct<start:int,kind:int,end:int,value:bigint>>, edges array<struct<pattern:string,value:bigint,kind:int,seed:boolean>>"
    return mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), work, schema, "pii")


_SPELLED = frozenset(f"{a}{w}{b}" for w in ("at", "dot", "@") for a, b in ("  ", "()", "[]", "{}", "<>") for a, b in [(a.strip(), b.strip())])


def ordinary(r: list[str], i: int) -> bool:
    """Whether no identifier can begin with word i of the lower-case words r: too few digits, no address."""
    w = r[i]
    if len(w) >= SECRET_LENGTH and mixed(w):
        return False
    if "@" in w or "::" in w or "(at)" in w or "[at]" in w or w.count(":") > 3 or (i + 1 < len(r) and r[i + 1] in _SPELLED):
        return False
    digits = 0
    for x in r[i : i + 8]:
        n = sum(c in "0123456789" for c in x)
        if not n:
            break
        digits += n
    return digits < LEAST_DIGITS and len(w.split(".")) < 4


def against(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, against): how many different ordinary words stand where the patterns of wanted (pattern) have their instances.

    Patterns grow with the corpus, so tasks do not get them but a filter of them of bounded size: 8 MB at most. What
    passes the filter and is not wanted is left out by a join. A pattern without ordinary words has no row.
    """
    key = F.col("pattern")
    is_front = key.startswith("j:")
    words = F.split(F.substring(key, 3, 1 << 20), " ")
    # the word before the place, and what is joined to its front
    left = F.when(key.startswith("2:"), words[1]).otherwise(words[0])
    keys = wanted.select(F.explode(F.array(key, F.when(~is_front, F.concat(F.lit("l:"), left)))).alias("key"))
    bits = docs.sparkSession.sparkContext.broadcast(bloom(keys, 2 * wanted.count()))
    # words count by their last 24 characters, so these are 24 numbers at most
    lengths = [r["n"] for r in wanted.filter(is_front).select((F.length("pattern") - 2).alias("n")).distinct().collect()]

    def work(batches):
        may = lambda strings: among(bits.value, strings)
        seen = set()
        for batch in batches:
            lefts, fronts = {}, {}
            for text in batch.column("text").to_pylist():
                low = (text or "").lower()
                r = low.split()
                t = ["x", "x", *(w[-24:] for w in _NUMBER.sub("0", low).split()), ""]
                fresh = list(set(t) - lefts.keys())
                lefts.update(zip(fresh, may([f"l:{w}" for w in fresh]).tolist(), strict=True))
                if lengths:
                    cuts = [(w, w[:n]) for w in fresh for n in lengths if n < len(w)]
                    for (w, f), hit in zip(cuts, may([f"j:{f}" for _, f in cuts]).tolist(), strict=True):
                        if hit:
                            fronts.setdefault(w, []).append(f)
                    for i, w in enumerate(r):
                        for f in fronts.get(t[i + 2], ()):
                            if len(w) > len(f) and ordinary([w[len(f) :], *r[i + 1 : i + 8]], 0):
                                seen.add((f"j:{f}", w))
                places = [i for i in range(len(r)) if lefts[t[i + 1]]]
                at = [p for i in places for p in (f"2:{t[i]} {t[i + 1]}", f"s:{t[i + 1]} _ {t[i + 3]}", f"1:{t[i + 1]}")]
                hits = may(at).reshape(-1, 3)
                for k in np.flatnonzero(hits.any(axis=1)).tolist():
                    if ordinary(r, places[k]):
                        seen |= {(at[3 * k + x], r[places[k]]) for x in range(3) if hits[k, x]}
            if len(seen) > 100_000:
                yield rows_of(seen)
                seen = set()
        yield rows_of(seen)

    def rows_of(seen):
        rows = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([_hash(w) for _, w in rows], pa.int64())], ["pattern", "word"])

    found = mapped(docs.select("text"), work, "pattern string, word long", "pii").distinct().groupBy("pattern").agg(F.count("*").alias("against"))
    return found.join(wanted, "pattern", "left_semi")


def bootstrap(edges: DataFrame, docs: DataFrame, support: float = SUPPORT, pattern_from: float = PATTERN_FROM, accept: float = ACCEPT) -> DataFrame:
    """(value, known): the look-alikes that are accepted, and how sure they are, from edges (pattern, value, kind, seed) of the texts of docs."""
    edges = written(edges.groupBy("pattern", "value", "kind").agg(F.max("seed").alias("seed")), "pii-edges")
    seeds = edges.filter("seed").select("value", F.lit(1.0).alias("known")).distinct()
    looks = edges.filter(~F.col("seed"))
    asked = looks.select("pattern").distinct()
    found = written(seeds.limit(0), "pii-found")
    counted = counts = None
    while True:
        known = seeds.unionByName(found)
        by_kind = edges.join(asked, "pattern", "left_semi").join(known, "value").groupBy("pattern", "kind").agg(F.sum("known").alias("known"))
        # of each pattern: its foremost kind, and what is known of the others
        best = by_kind.groupBy("pattern").agg(F.sum("known").alias("all"), F.max_by("kind", F.struct("known", -F.col("kind"))).alias("kind"), F.max("known").alias("known"))
        best = best.filter((F.col("known") >= support) & (F.col("known") / (F.col("all") + 1) >= pattern_from))
        best = written(best, "pii-patterns")
        new = best.select("pattern") if counted is None else best.select("pattern").join(counted, "pattern", "left_anti")
        new = written(new, "pii-asked")
        if not new.isEmpty():
            more = written(against(docs, new), "pii-against")
            counts = more if counts is None else counts.unionByName(more)
            counted = new if counted is None else counted.unionByName(new)
        if counts is None:
            break
        good = best.join(counts, "pattern", "left").select("pattern", "kind", (F.col("known") / (F.col("all") + F.coalesce("against", F.lit(0)) + 1)).alias("score")).filter(F.col("score") >= pattern_from)
        fresh = looks.join(good, ["pattern", "kind"]).groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("known"))
        fresh = written(fresh.filter(F.col("known") >= accept).join(known, "value", "left_anti"), "pii-found")
        if not fresh.count():
            break
        found = written(found.unionByName(fresh), "pii-found")
    return found.select("value", "known")


def chosen(scanned: DataFrame, accepted: DataFrame) -> DataFrame:
    """(_d, _h, more): of each document the accepted look-alikes; of those that overlap the surest, then the longest."""

    def work(batches):
        for batch in batches:
            out = []
            for found in batch.column("more").to_pylist():
                kept = []
                for x in sorted(found, key=lambda x: (-round(x["known"], 9), x["start"] - x["end"], x["start"], x["kind"])):
                    if all(x["end"] <= y["start"] or y["end"] <= x["start"] for y in kept):
                        kept.append({k: x[k] for k in ("start", "kind", "end")})
                out.append(sorted(kept, key=lambda x: x["start"]))
            yield pa.RecordBatch.from_arrays([batch.column("_d"), batch.column("_h"), pa.array(out, pa.list_(_SPAN))], ["_d", "_h", "more"])

    looks = scanned.select("doc_id", "text_hash", F.explode("looks").alias("l")).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "l.*")
    more = looks.join(accepted, "value").groupBy("_d", "_h").agg(F.collect_set(F.struct("known", "start", "kind", "end")).alias("more"))
    return written(mapped(more, work, f"_d long, _h long, more {_SPANS}", "pii"), "pii-more")


def find(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, text_hash, base, base_sha, spans): spans are the base ones, secrets, and those that the bootstrap adds."""
    scanned = written(scan(docs), "pii-scan")
    accepted = bootstrap(scanned.select(F.explode("edges").alias("e")).select("e.*"), docs, **how)
    more = chosen(scanned, accepted)
    same = scanned["doc_id"].eqNullSafe(more["_d"]) & (scanned["text_hash"] == more["_h"])
    added = F.coalesce("more", F.array().cast(_SPANS))
    spans = F.when(F.size("secrets") + F.size(added) == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", "secrets", added)))
    return scanned.join(more, same, "left").select("doc_id", "text_hash", "base", "base_sha", spans.alias("spans"))


def redact(docs: DataFrame, **how) -> DataFrame:
    """docs with each span of its text replaced by its kind in angle brackets, and n_chars, if there, made anew.

    Base spans and secrets are found again where the text is; only the few rows that the bootstrap adds to are joined.
    """
    scanned = written(scan(docs), "pii-scan")
    accepted = bootstrap(scanned.select(F.explode("edges").alias("e")).select("e.*"), docs, **how)
    more = chosen(scanned, accepted).withColumnRenamed("more", "_more")
    names = docs.columns
    kept = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at, text_at = names.index("doc_id"), names.index("text")

    # a small written table: a broadcast by its size, else a join on the id
    by_doc = more.groupBy("_d").agg(F.collect_list(F.struct("_h", "_more")).alias("_more"))
    rows = kept.join(by_doc, kept[f"c{at}"].cast("long").eqNullSafe(by_doc["_d"]), "left").drop("_d")
    n_at = names.index("n_chars") if "n_chars" in names else None

    def work(batches):
        for batch in batches:
            texts = batch.column(f"c{text_at}").to_pylist()
            extra = batch.column("_more").to_pylist()
            out = []
            for text, more_ in zip(texts, extra, strict=True):
                if not text:
                    out.append(text)
                    continue
                spans = base_spans(text)
                spans += secrets(text, spans)
                if more_:
                    h = _hash(text)
                    spans += [(s["start"], s["kind"], s["end"]) for m in more_ if m["_h"] == h for s in m["_more"]]
                out.append(replaced(text, spans))
            columns = [pa.array(out, pa.string()) if i == text_at else pa.array([None if t is None else len(t) for t in out], pa.int64()) if i == n_at else batch.column(f"c{i}") for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(names))])

    schema = ", ".join(f"c{i} {'string' if i == text_at else 'bigint' if i == n_at else f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return mapped(rows, work, schema, "pii").toDF(*names)


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans that overlap are one, named by the first of them."""
    out, end = [], 0
    for a, k, b in sorted(spans):
        if a >= end:
            out += [text[end:a], f"<{KINDS[k].upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns; then how many secrets and how many spans of any kind there are."""
    n = lambda k, of="base": F.size(F.filter(of, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(n, range(4)), F.lower(F.hex("base_sha")).alias("base_sha256"), spans.alias("spans"), n(SECRET, "spans"), F.size("spans").cast("long").alias("n_spans"))
