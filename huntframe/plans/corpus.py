"""Batch jobs over a corpus of detection rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntframe.functions.predicates import Field, col_of, text
from huntframe.operators.skew import rank_within, salted_join

# Fixed value: names of normalized event tables as they occur in rule text.
NORMALIZED_TABLE = r"\b(im[A-Z]\w*|_Im_\w*|ASim\w*)\b"

# The event type a rule reads, by the first table pattern found in its text.
EVENT_TYPE_PATTERNS = {
    "AuthenticationEvent": r"\b(im|ASim|_Im_)Authentication\b",
    "NetworkSessionEvent": r"\b(im|ASim|_Im_)NetworkSession\b",
    "ProcessEvent": r"\b(im|ASim|_Im_)Process(Create|Terminate|Event)?\b",
    "FileEvent": r"\b(im|ASim|_Im_)FileEvent\b",
    "DnsEvent": r"\b(im|ASim|_Im_)Dns\b",
    "WebSessionEvent": r"\b(im|ASim|_Im_)WebSession\b",
    "RegistryEvent": r"\b(im|ASim|_Im_)Registry(Event)?\b",
}

# Words of the query language that are never field names.
LANGUAGE_WORDS = """
    let where summarize project extend join bin by and or not
    contains startswith endswith in has has_any has_all
    count count_ dcount dcountif countif sum avg min max
    make_set make_list percentile percentiles arg_max arg_min ago now strcat split
    tostring toint tolong todatetime todynamic dynamic isnotempty
    isempty isnull isnotnull format_datetime case iff extract
    parse true false kind inner outer leftouter on render
    top sort order desc asc distinct union datatable print
    toscalar trim substring strlen indexof replace tolower
    toupper bag_pack pack array_length set_difference set_union
    iif strcat_array todouble toreal tobool tohex
    datetime_diff startofday startofweek startofmonth endofday
    format_timespan totimespan geo_distance_2points ipv4_is_match
    ipv4_is_in_range parse_json bag_unpack mv-expand mv_expand
    materialize hint shuffle with step range series_decompose
    hassuffix hasprefix notcontains matches regex away expand
    mv leftanti rightouter fullouter anti semi between
    ipv6_is_match geo_info_from_ip_address indexof_regex tostring_array
    make series from to series_decompose_anomalies
""".split()

# String literals, tokens, and the places where a query defines a name of its own (let
# binding, assignment, named argument; tuple of names), then the first word of the main query.
STRING_LITERAL = r"""@'[^']*'|@"[^"]*"|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
TOKEN = r"\b([A-Za-z_][A-Za-z0-9_]*)\b"
OWN_NAMES = (
    r"\blet\s+(\w+)\s*=",
    r"(?:summarize|extend|project|make-series|,)\s+(\w+)\s*=(?!=)",
    r"[(,]\s*([a-z][a-z0-9_]*)\s*=(?!=)",
)
OWN_TUPLES = r"\(\s*([\w\s,]+?)\s*\)\s*=(?!=)"
FIRST_WORD = r"^\s*(_?\w+)"
FOREIGN_SYNTAX = r"(?i)\b(SELECT|GROUP\s+BY|stats\s+count)\b"

# Literals that need no mention in a description, and endings that may be added.
COMMON_LITERALS = """
    true false success failure denied allowed blocked
    permit deny error warning info unknown none null
    noerror nxdomain servfail refused formerr notimp
""".split()
COMMON_SUFFIXES = (".exe", ".dll", ".com", ".bat", ".ps1", ".sh")


def stripped(x: Field) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(text(x), r"(?U)^\s+|\s+$", "")


def usable_rules(df: DataFrame, description: str, query: str, route: str = "is_normalized") -> DataFrame:
    """Rules with a real description and no template marks, flagged by whether they read a normalized table."""
    told, asked = stripped(description), stripped(query)
    kept = df.filter((F.length(told) >= 20) & ~told.contains("{{") & ~asked.contains("{{"))
    return kept.withColumn(route, asked.rlike("(?U)" + NORMALIZED_TABLE))


def _count_of(subject: Column, needle: str) -> Column:
    return (F.length(subject) - F.length(F.replace(subject, F.lit(needle), F.lit("")))) / len(needle)


def key_count(query: Field) -> Column:
    """Keys after the first ``by`` of a query: commas outside any bracket, plus one."""
    q = text(query)
    after = F.substring(q, F.instr(q, " by ") + 4, F.length(q))
    clause = F.substring_index(after, "|", 1)
    marks = F.split(F.regexp_replace(clause, r"[^()\[\],]", ""), "")
    state = F.aggregate(
        marks, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("commas")),
        lambda s, ch: F.struct(
            (s["depth"] + F.when(ch.isin("(", "["), 1).when(ch.isin(")", "]"), -1).otherwise(0)).alias("depth"),
            (s["commas"] + F.when((ch == ",") & (s["depth"] == 0), 1).otherwise(0)).alias("commas")))
    return F.when(q.contains(" by "), state["commas"] + 1).otherwise(0)


def complexity_tier(query: Field) -> Column:
    """``simple``, ``moderate`` or ``complex``, from the shape of a query's text."""
    q = text(query)
    grouped = q.contains("| summarize")
    filters = _count_of(q, "| where")
    hard = (q.contains("| join") | (grouped & (key_count(query) >= 3)) | (~grouped & (filters >= 5)))
    return F.when(hard, "complex").when(grouped, "moderate").otherwise("simple")


def event_type_of(query: Field) -> Column:
    """The first event type whose table name occurs, null when none does."""
    q = text(query)
    return F.coalesce(*[F.when(q.rlike("(?iu)" + pattern), F.lit(name))
                        for name, pattern in EVENT_TYPE_PATTERNS.items()])


def without_comments_and_strings(query: Field) -> Column:
    """Query text with line comments removed and string literals emptied."""
    plain = F.regexp_replace(text(query), r"//[^\n]*", "")
    return F.regexp_replace(plain, STRING_LITERAL, "''")


def local_names(cleaned: Column) -> Column:
    """Names a query defines itself: let bindings, assignments, named arguments, tuple targets."""
    def found(pattern: str) -> Column:
        return F.regexp_extract_all(cleaned, F.lit(pattern), F.lit(1))

    tuples = F.flatten(F.transform(found(OWN_TUPLES),
                                   lambda g: F.transform(F.split(g, ","), lambda w: F.trim(w))))
    return F.concat(*map(found, OWN_NAMES), tuples)


def source_table(cleaned: Column) -> Column:
    """The first word of the main query, after any ``let`` statement."""
    main = F.element_at(F.split(cleaned, ";"), -1)
    lines = F.filter(F.split(main, r"\R"), lambda l: ~l.rlike(r"^\s*$") & ~l.rlike(r"^\s*let\s+\w+\s*="))
    word = F.regexp_extract(F.get(lines, F.lit(0)), FIRST_WORD, 1)
    return F.when(word != "", word)


def referenced_names(cleaned: Column) -> Column:
    """Distinct names in cleaned query text that are neither language words nor its own definitions."""
    tokens = F.regexp_extract_all(cleaned, F.lit(TOKEN), F.lit(1))
    fields = F.filter(tokens, lambda w: ~w.isin(*LANGUAGE_WORDS))
    own = F.concat(local_names(cleaned), F.array(F.coalesce(source_table(cleaned), F.lit(""))))
    return F.array_except(fields, own)


def audit_rules(df: DataFrame, query: str, fields: dict[str, list[str]]) -> DataFrame:
    """Adds each rule's event type, the names that type does not have, and a list of flags.

    ``fields`` maps an event type to its field names.
    """
    # Intermediate results are columns of their own, so that each is worked out once per rule.
    read = (df.withColumn("event_type", event_type_of(query))
            .withColumn("_clean", without_comments_and_strings(query))
            .withColumn("_names", F.sort_array(referenced_names(F.col("_clean")))))
    unknown = F.array().cast("array<string>")
    for kind, allowed in fields.items():
        unlisted = F.array_except("_names", F.array(*[F.lit(f) for f in allowed]))
        unknown = F.when(F.col("event_type") == kind, unlisted).otherwise(unknown)
    leaked = F.col("_clean").rlike(FOREIGN_SYNTAX)
    flags = F.array(
        F.when(leaked, F.lit("FOREIGN_SYNTAX")),
        F.when(F.col("event_type").isNull(), F.lit("NO_EVENT_TYPE_DETECTED")),
        F.when(F.size("unknown_names") > 0, F.lit("UNKNOWN_TOKENS")))
    return (read.withColumn("unknown_names", unknown)
            .withColumn("flags", F.array_compact(flags)).drop("_clean", "_names"))


def seeded_order(seed: int | str, key: Field) -> Column:
    """A repeatable shuffle: the hash of the seed and the key."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), text(key)))


def stratified_split(df: DataFrame, key: str, stratum: str, fraction: float, seed: int = 42) -> DataFrame:
    """Per stratum, ``round(n * fraction)`` keys go to ``test``, the others to ``train``.

    The hash order is cut by hash prefix, so that no stratum is sorted as a whole in one task.
    """
    ids = df.select(stratum, key).distinct().withColumn("_h", seeded_order(seed, key))
    ranked = rank_within(ids, [stratum], [F.col("_h"), F.col(key)], F.substring("_h", 1, 3))
    quota = F.bround(F.col("rank_of") * F.lit(float(fraction)), 0)
    side = F.when(F.col("rank") <= quota, "test").otherwise("train")
    return ranked.select(stratum, key, side.alias("split"))


def evaluation_pool(df: DataFrame, used: DataFrame, key: str, description: str, query: str,
                    target: int, seed: int = 42) -> DataFrame:
    """Fresh rules: every simple and moderate one, filled up to ``target`` with complex ones.

    Left out are used keys, short or deprecated descriptions and templated queries.
    """
    told = stripped(description)
    fresh = (df.join(used.select(key).distinct(), key, "left_anti")
             .filter((F.length(told) >= 20) & ~text(query).contains("{{")
                     & ~F.lower(text(description)).contains("deprecated"))
             .withColumn("tier", complexity_tier(query)))
    small = fresh.filter(F.col("tier") != "complex")
    taken = small.agg(F.count(F.lit(1)).alias("n"))
    # At most ``target`` complex rules can be needed; the budget then cuts this short list.
    shortlist = (fresh.filter(F.col("tier") == "complex")
                 .withColumn("_h", seeded_order(seed, key)).orderBy("_h", key).limit(target))
    # One group, but of at most ``target`` rows.
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_h", key))
    filler = (shortlist.withColumn("_rn", place).withColumn("_taken", taken.scalar())
              .filter(F.col("_rn") + F.col("_taken") <= target))
    return small.unionByName(filler.drop("_h", "_rn", "_taken"))


def verified_pairs(rules: DataFrame, verdicts: DataFrame, variants: DataFrame, key: str,
                   original: str) -> DataFrame:
    """Kept rules as (rule, phrasing, text): the original wording and each rewritten one."""
    kept = rules.join(verdicts.filter(F.col("verdict") == "keep").select(key).distinct(), key, "left_semi")
    wide = kept.select(key, F.col(original).alias("original")).join(variants, key)
    phrasings = [c for c in wide.columns if c != key]
    return wide.unpivot(key, phrasings, "phrasing", "description").filter(F.col("description").isNotNull())


def construct_coverage(df: DataFrame, query: str, constructs: dict[str, tuple[str, str]],
                       at_least: int = 5) -> DataFrame:
    """How many rules use each construct, and the share of frequent constructs by support status.

    ``constructs`` maps a name to its regex and status; it is a short list, counted in one pass.
    """
    q = text(query)
    counts = df.agg(*[F.count_if(q.rlike(regex)).alias(f"_{i}")
                      for i, (regex, _) in enumerate(constructs.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("construct"), F.lit(status).alias("status"),
                              F.col(f"_{i}").alias("rules"))
                     for i, (name, (_, status)) in enumerate(constructs.items())])
    return counts.select(F.inline(rows)).filter(F.col("rules") >= at_least)


def coverage_share(frequent: DataFrame) -> DataFrame:
    """Share of the frequent constructs by status."""
    total = frequent.agg(F.count(F.lit(1)).alias("n"))
    return frequent.groupBy("status").agg(F.count(F.lit(1)).alias("constructs")).withColumn(
        "share", F.col("constructs") / total.scalar())


def split_camel_case(x: Field) -> Column:
    return F.regexp_replace(text(x), r"(?<=[a-z0-9])(?=[A-Z])", " ")


def closest_name(name: Field, names: list[str]) -> Column:
    """The listed name at the smallest edit distance, case ignored; the first of equals."""
    subject = F.lower(text(name))
    scored = F.array(*[F.struct(F.levenshtein(subject, F.lit(n.lower())).alias("d"), F.lit(i).alias("i"),
                                F.lit(n).alias("name")) for i, n in enumerate(names)])
    return F.array_min(scored)["name"]


def closest_names(df: DataFrame, field: str, names: list[str]) -> DataFrame:
    """Each distinct value with its closest listed name; the distance is worked out once per value."""
    return df.select(field).distinct().withColumn("closest", closest_name(field, names))


def _with_deletions(word: Column, most: int) -> Column:
    """A word and all that is left of it when up to ``most`` of its characters are taken out."""
    def shorter(words: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(
            F.filter(F.sequence(F.lit(0), F.length(w)), lambda i: i > 0),
            lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w)))))))

    found = F.array(word)
    whole = found
    for _ in range(most):
        found = shorter(found)
        whole = F.concat(whole, found)
    return F.array_distinct(whole)


def closest_within(df: DataFrame, field: str, names: DataFrame, name: str, most: int = 2, salts: int = 0) -> DataFrame:
    """Each distinct value with the name of a table at the smallest edit distance of up to ``most``, case ignored, and that
    distance (``closest``, ``distance``); of equally near names the first in alphabetical order. Nulls where there is none.

    Two words at most ``most`` edits apart agree in something that is left of both after up to ``most`` deletions. Values
    and names meet by equality of that, so only near pairs are compared, however long the table of names is. A word of n
    letters has about n^most / most! such rests: meant for names, not for texts.
    """
    if not 0 <= most <= 3:
        raise ValueError("a distance from 0 to 3")
    # Names that differ in case only are one word, called by the first of them.
    words = names.filter(F.col(name).isNotNull()).groupBy(F.lower(F.col(name).cast("string")).alias("_word")).agg(F.min(name).alias("_name"))
    words = words.withColumn("_rest", F.explode(_with_deletions(F.col("_word"), most)))
    values = df.select(F.col(field).alias("_value")).distinct()
    asked = values.filter(F.col("_value").isNotNull()).withColumn("_asked", F.lower(F.col("_value").cast("string")))
    asked = asked.withColumn("_rest", F.explode(_with_deletions(F.col("_asked"), most)))
    met = salted_join(asked, words, ["_rest"], "inner", salts) if salts else asked.join(words, "_rest")
    far = F.levenshtein("_asked", "_word", most)  # -1 beyond
    near = met.withColumn("_d", far).filter("_d >= 0").groupBy("_value").agg(F.min(F.struct("_d", "_name")).alias("_best"))
    return values.join(near, "_value", "left").select(
        F.col("_value").alias(field), F.col("_best._name").alias("closest"), F.col("_best._d").cast("long").alias("distance"))


def is_ungrounded(value: Field, description: Field) -> Column:
    """Whether a literal of a rule is found nowhere in its description.

    Short and common values, and values that only add a program ending, count as grounded.
    """
    word, told = F.lower(stripped(value)), F.lower(text(description))
    grounded = (F.length(word) < 4) | word.isin(*COMMON_LITERALS) | told.contains(word)
    for suffix in COMMON_SUFFIXES:
        stem = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        grounded = grounded | (word.endswith(suffix) & told.contains(stem))
    known = col_of(value).isNotNull() & (text(description) != "")
    return known & ~grounded
