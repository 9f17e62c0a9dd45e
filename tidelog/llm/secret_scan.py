"""Secret scan: candidate strings judged by a random forest that is compiled to a SQL expression. DataFrame functions only on the main path."""

from __future__ import annotations

import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table

#: Sixteen characters or more of the alphabets keys are written in, a digit and a letter among them.
CANDIDATE = r"(?=[A-Z0-9+/_\-]*[a-z]|[a-z0-9+/_\-]*[A-Z])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}"
#: Words of ordinary text, names of files and identifiers.
DICTIONARY = "about access account admin archive article asset backup bank build cache chapter class client code commit config content count create data date default delete demo detail document download draft edition email engine error event example file final folder format group guide header home html http image index info item json key language library license link list local login main manual media menu message meta method model module name network news note number object order page paper part path phone photo plan post price print product profile program project public query readme record release report request result review sample schema script search section server service session setting source story style summary system table target task template test text theme time title topic type update upload user value version video view week world year".split()
NEAR_SECRET = "(?i)passw|pwd|secret|token|api.?key|access.?key|auth|credential|private|bearer"
NEAR_HARMLESS = "(?i)example|sample|dummy|placeholder|commit|sha-?[0-9]|md5|checksum|hash|uuid|digest|integrity|revision|isbn|version|build|fixture"
KNOWN_PREFIX = "^(AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk_live_|sk-|xox[abp]-|AIza|eyJ)"
FEATURES = ("length", "class_changes", "known_transitions", "dictionary", "digits", "upper", "hex_only", "pathlike", "near_secret", "near_harmless", "known_prefix", "variety", "after_secret", "after_harmless")


def known_transitions() -> str:
    """A pattern of the letters that are followed by a letter which follows them in the dictionary's words too: a letter's transitions as one alternative."""
    after: dict[str, set[str]] = {}
    for word in DICTIONARY:
        for a, b in zip(word, word[1:], strict=False):
            after.setdefault(a, set()).add(b)
    return "(?i)" + "|".join(f"{a}(?=[{''.join(sorted(b))}])" for a, b in sorted(after.items()))


def features(c: Column, left: Column, right: Column, path: Column) -> list[Column]:
    """The doubles that the forest splits on, in the order of FEATURES. left, right: neighbouring words with the rest of the candidate's own word."""
    n = F.length(c).cast("double")
    share = lambda pattern: (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / n
    near = F.concat_ws(" ", left, path)
    flag = lambda x: x.cast("double")
    return [
        n,
        F.length(F.regexp_replace(c, "[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+", "x")) / n,
        F.regexp_count(c, F.lit(known_transitions())) / F.greatest(F.lit(1.0), n - 1),
        share("(?i)" + "|".join(sorted(DICTIONARY, key=len, reverse=True))),
        share("[0-9]"),
        share("[A-Z]"),
        flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        F.regexp_count(F.concat(left, c, F.regexp_extract(right, r"^\S*", 0)), F.lit(r"[/\\]|://|\.[a-z]{2,4}\b")).cast("double"),
        flag(near.rlike(NEAR_SECRET)),
        flag(near.rlike(NEAR_HARMLESS)),
        flag(c.rlike(KNOWN_PREFIX)),
        F.size(F.array_distinct(F.split(c, ""))) / n,
        flag(right.rlike(NEAR_SECRET)),
        flag(right.rlike(NEAR_HARMLESS)),
    ]


def labelled_findings(n: int = 1200, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """(candidate, left, right, path, label): findings drawn by rule and labelled by the rule that drew them. No labelled findings are given with the tables; a caller's own can be passed to scan. n is the bound of the training set."""
    rng = random.Random(seed)
    up, low, hexa, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    words = lambda k: " ".join(draw(low, rng.randint(2, 8)) if rng.random() < 0.5 else rng.choice(DICTIONARY) for _ in range(k))
    key = lambda: rng.choice(["password=", "token = \"", "secret: ", "api_key=", "API-KEY: ", "passwd: ", "auth_token=", "access_key = '", "Authorization: Bearer "])
    harmless = lambda: rng.choice(["commit ", "sha256: ", "md5 ", "checksum=", "uuid ", "example ", "build ", "version ", "digest: ", "revision "])
    # what follows has a rng of its own: a hint there decides where nothing before the candidate does
    after = random.Random(seed + 1)
    secret_after = lambda: after.choice([" is the password", " (api key)", " as secret for it", " was their token"])
    harmless_after = lambda: after.choice([" is the commit", " (sha256)", " as checksum of it", " was the build"])
    out = []
    for i in range(n):
        kind, tail = i % 12, rng.choice(["", "\"", "'", ".", ","])
        if kind < 2:
            out.append((rng.choice(["AKIA", "ASIA"]) + draw(up, 16), words(3) + " ", tail, "", 1))
        elif kind == 2:
            out.append((rng.choice(["ghp_", "sk_live_", "xoxb-", "AIza", "glpat-", "sk-"]) + draw(mixed, rng.randint(24, 40)), words(3) + " ", tail, "", 1))
        elif kind == 3:
            out.append((draw(hexa, rng.choice([18, 24, 32, 40, 64])), words(2) + " " + key(), tail, "", 1))
        elif kind == 4:
            out.append((draw(mixed + "+/_-", rng.randint(16, 48)), words(2) + " " + key(), tail, "", 1))
        elif kind == 5:
            out.append((draw(mixed, rng.randint(32, 64)), words(3) + " ", tail, "", 1))
        elif kind == 6:
            out.append((draw(hexa, rng.choice([32, 40, 64])), words(2) + " " + harmless(), tail, "", 0))
        elif kind == 7:
            out.append((draw(hexa, rng.choice([32, 40, 64])), words(3) + " ", tail, "tests/fixtures/data.json", 0))
        elif kind == 8:
            out.append(("/".join(rng.choice(DICTIONARY) for _ in range(rng.randint(2, 5))) + str(rng.randint(0, 9999)), words(2) + " ", rng.choice([".html", ".py", "", ".jpg"]), "", 0))
        elif kind == 9:
            out.append((rng.choice("-_").join(rng.choice(DICTIONARY) for _ in range(rng.randint(3, 5))) + "-" + str(rng.randint(0, 99999)), words(3) + " ", tail, "", 0))
        elif kind == 10:
            out.append((draw(low, rng.randint(15, 28)) + str(rng.randint(0, 9)), words(3) + " ", tail, "", 0))
        else:
            out.append(("".join(rng.choice(DICTIONARY).title() for _ in range(rng.randint(3, 5))) + str(rng.randint(0, 99)), words(2) + " " + rng.choice([key(), ""]), tail, "", 0))
        c, left, right, path, label = out[-1]
        if kind in (3, 6) and after.random() < 0.3:
            left, right = " ".join(after.choice(DICTIONARY[:8]) for _ in range(3)) + " ", right + (secret_after() if label else harmless_after())
        else:
            right += after.choice([secret_after(), harmless_after(), " " + " ".join(after.sample(DICTIONARY[:8], 3)), ""])
        out[-1] = (c, left, right, path, label)
    return out


def _gini_split(rows, labels, columns):
    """(gain, feature, threshold) of the best split of rows among columns, or None."""
    n, ones = len(labels), sum(labels)
    here, best = 2 * ones * (n - ones) / n, None
    for f in columns:
        order = sorted(range(n), key=lambda i: rows[i][f])
        left = left_ones = 0
        for at, i in enumerate(order[:-1]):
            left, left_ones = left + 1, left_ones + labels[i]
            a, b = rows[i][f], rows[order[at + 1]][f]
            if a < b and min(left, n - left) >= 3:
                right, right_ones = n - left, ones - left_ones
                gain = here - 2 * left_ones * (left - left_ones) / left - 2 * right_ones * (right - right_ones) / right
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, (a + b) / 2)
    return best


def _grow(rows, labels, rng, depth):
    """A tree: a leaf's share of ones, or (feature, threshold, at most it, above it)."""
    ones = sum(labels)
    split = _gini_split(rows, labels, rng.sample(range(len(FEATURES)), 4)) if depth and 0 < ones < len(labels) else None
    if split is None:
        return (ones + 1) / (len(labels) + 2)
    _, f, t = split
    low = [i for i, r in enumerate(rows) if r[f] <= t]
    high = [i for i, r in enumerate(rows) if r[f] > t]
    return (f, t, *(_grow([rows[i] for i in part], [labels[i] for i in part], rng, depth - 1) for part in (low, high)))


def fit_forest(rows: list[list[float]], labels: list[int], trees: int = 15, depth: int = 6, seed: int = 11) -> list:
    """Trees grown on bootstrap samples with four features tried at each split."""
    rng, forest = random.Random(seed), []
    for _ in range(trees):
        pick = [rng.randrange(len(rows)) for _ in rows]
        forest.append(_grow([rows[i] for i in pick], [labels[i] for i in pick], rng, depth))
    return forest


def forest_probability(forest: list, values: list[Column]) -> Column:
    """The mean of the trees' leaves, as nested CASE expressions."""
    as_case = lambda t: F.lit(float(t)) if isinstance(t, float) else F.when(values[t[0]] <= F.lit(float(t[1])), as_case(t[2])).otherwise(as_case(t[3]))
    total = as_case(forest[0])
    for t in forest[1:]:
        total = total + as_case(t)
    return total / F.lit(float(len(forest)))


@lru_cache(maxsize=4)
def _trained(app: str, n: int, seed: int, given: tuple = ()) -> list:
    """The forest on the given findings, or on labelled_findings, its features taken by the same expressions that score."""
    spark = SparkSession.active()
    found = spark.createDataFrame(list(given) or labelled_findings(n, seed), "c string, l string, r string, p string, y int")
    rows = found.select("y", *features(F.col("c"), F.col("l"), F.col("r"), F.col("p"))).collect()  # n rows: the bound of labelled_findings, or the caller's own list
    return fit_forest([[float(x) for x in r[1:]] for r in rows], [int(r[0]) for r in rows])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, threshold: float = 0.5, mask: str = "<SECRET>", n_train: int = 1200, seed: int = 7, findings: list[tuple[str, str, str, str, int]] | None = None) -> DataFrame:
    """docs with `findings` (candidate, left, probability), `secrets` (strings taken as real) and `clean_text` (each secret replaced by mask).

    Every candidate of every word is judged, each with its own neighbours before and after. One pass over whole texts, without a shuffle: candidates, neighbours and the forest are array expressions of the row. A
    null text gives empty arrays and a null clean_text, an empty text empty arrays and an empty one; repeated rows and null ids are scanned each by itself. Columns of docs
    named as those added are replaced. path: where a document comes from, for example its file or source. findings: labelled findings (candidate, text before, text after, path, 1 for a real
    secret) to train on, a list in memory; without them n_train are drawn by rule.
    """
    forest = _trained(docs.sparkSession.sparkContext.applicationId, n_train, seed, tuple(findings or ()))
    where = F.lit("") if path is None else F.coalesce(path, F.lit(""))
    words = F.split(F.col(text_col), r"\s+")
    has = F.col(text_col).rlike(CANDIDATE)
    at = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.element_at("_words", i + 1).rlike(CANDIDATE))

    def parts(i: Column) -> Column:
        """A word's candidates and what is around them: one gap more than candidates."""
        w = F.element_at("_words", i + 1)
        return F.struct(i.alias("i"), F.regexp_extract_all(w, F.lit(CANDIDATE), F.lit(0)).alias("cs"), F.split(w, CANDIDATE).alias("gaps"))

    def one(p: Column, j: Column) -> Column:
        """Neighbours are three units before and after: first those of the same word (a candidate with the gap at its side), then words."""
        i, cs, gaps, gap = p["i"], p["cs"], p["gaps"], F.element_at(p["gaps"], j + 1)
        glue = lambda a, b: F.array_join(F.zip_with(a, b, lambda x, y: F.concat(x, y)), "")
        back, ahead = F.least(j, F.lit(3)), F.least(F.size(cs) - j - 1, F.lit(3))
        inner = glue(F.slice(gaps, j - back + 1, back), F.slice(cs, j - back + 1, back))
        n = F.least(i, 3 - back)
        left = F.concat_ws(" ", F.slice("_words", F.greatest(i - n + 1, F.lit(1)), n), F.concat(inner, gap))
        # between two candidates a name, such as the key of a value, belongs to the second alone
        left = F.when((j > 0) & gap.rlike("[A-Za-z]{2}"), gap).otherwise(left)
        rest = F.concat(F.element_at(gaps, j + 2), glue(F.slice(cs, j + 2, ahead), F.slice(gaps, j + 3, ahead)))
        return F.struct(F.element_at(cs, j + 1).alias("c"), left.alias("left"), F.concat_ws(" ", rest, F.slice("_words", i + 2, 3 - ahead)).alias("right"))

    def all_of(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(p["cs"]) - 1), lambda j: one(p, j))

    def judged(x: Column) -> Column:
        return F.struct(x["c"].alias("candidate"), x["left"].alias("left"), F.array(*features(x["c"], x["left"], x["right"], where)).alias("f"))

    def scored(x: Column) -> Column:
        return F.struct(x["candidate"].alias("candidate"), x["left"].alias("left"), F.round(forest_probability(forest, [F.element_at(x["f"], k + 1) for k in range(len(FEATURES))]), 6).alias("probability"))

    none = F.array().cast("array<struct<candidate:string,left:string,probability:double>>")
    out = docs.withColumn("_words", F.when(has, words))
    out = out.withColumn("findings", F.when(F.col("_words").isNull(), none).otherwise(F.transform(F.transform(F.flatten(F.transform(F.transform(at, parts), all_of)), judged), scored)))
    out = out.withColumn("secrets", F.array_distinct(F.transform(F.filter("findings", lambda x: x["probability"] >= threshold), lambda x: x["candidate"]))).drop("_words")
    longest_first = F.array_sort("secrets", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return out.withColumn("clean_text", F.aggregate(longest_first, F.col(text_col), lambda t, s: F.replace(t, s, F.lit(mask))))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many candidates, how many judged secret, their digest, and the digest of the masked text."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path=F.col("source"))
    return out.select("doc_id", F.size("findings").alias("n_candidates"), F.size("secrets").alias("n_secrets"), F.transform("secrets", lambda s: F.sha2(s, 256)).alias("secret_sha256"), F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"))
