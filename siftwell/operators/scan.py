"""Matches of the rule catalog in files, graded by context, as findings and signals.

A text goes on if it holds a string that some rule needs, a run that may be
encoded, or overlong lines; those few are stored, and all else is derived from
them. Lines are tested against their text's rules in one projection; wording is
matched over whole paragraphs too, so a sentence may wrap. Context is looked up
in each text's intervals and lines, and a ladder of expressions grades each
match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.ranks import demote, lower_confidence, promote
from siftwell.functions.text import clip, found_at, mask_matches, one_line, one_of, reveal_invisible, settled, words_held
from siftwell.operators import classify, payloads
from siftwell.operators.catalog import NEEDS_PATTERN, NEEDS_STRING, NEEDS_WORD, RULES, Rule, rules_table
from siftwell.operators.downloads import download_hits
from siftwell.operators.lines import is_cautionary, line_index
from siftwell.operators.references import with_references
from siftwell.operators.rollup import dedupe, worst
from siftwell.operators.spans import contexts, placed, text_matches, unwrapped
from siftwell.operators.unicode_runs import RARE
from siftwell.session import stored

#: Words of a clause by which it forbids, or describes, what follows in it. Fixed values.
NEGATES = r"(?i)\b(?:never|not|don't|doesn't|won't|cannot|can't|mustn't|shouldn't|no|nor|avoid|refuse|without|instead of)\b"
DESCRIBES = r"(?i)\b(?:detects?|checks? for|looks? for|flags?|finds?|examples? of|signs? of|attempts? to|tries to|such as|whether|if (?:an|the|a)|attackers?|malicious)\b"

KEEP = ("bundle_id", "path", "kind", "role", "path_context")
SNIPPET = 160
#: What is masked in snippets.
SECRETS = next(r.pattern for r in RULES if r.id == "secrets/embedded-credential")
FINDINGS_PER_BUNDLE = 500


def as_files(docs: DataFrame, path: Column, bundle: Column, text: Column) -> DataFrame:
    """Rows of any table as files: bundle_id, file_id (a hash of bundle and path), path, kind, role, path_context and text."""
    head = F.substring_index(F.substring(text, 1, 200), "\n", 1)
    rows = docs.select(bundle.alias("bundle_id"), path.alias("path"), text.alias("text"), head.alias("_head"))
    rows = rows.withColumn("kind", classify.kind(F.col("path"), F.col("_head"), F.lit(False))).drop("_head")
    return rows.select("bundle_id", F.xxhash64("bundle_id", "path").alias("file_id"), "path", "kind", classify.role(F.col("path"), F.col("kind")).alias("role"), classify.path_context(F.col("path"), F.col("kind")).alias("path_context"), "text")


#: Rules of single odd characters, which are looked for at once.
ODD_RULES = ("unicode/terminal-escape", "unicode/bidi-control", "unicode/zero-width", "unicode/tag-characters", "unicode/variation-selector-smuggling", "unicode/invisible-filler")
#: Those characters: controls and escapes, direction marks, of no width, fillers, variation selectors, tags. Fixed values.
ODD = r"[\x00-\x08\x0E-\x1F\x7F\u115F\u1160\u200B\u202A-\u202E\u2060-\u2069\u3164\uFE00-\uFE0F\uFEFF\uFFA0\x{E0001}\x{E0020}-\x{E007F}\x{E0100}-\x{E01EF}]"


def gate(files: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """files that hold anything to look at, with may, the places of the rules that may match, hides, whether something may be encoded or invisible, and dense, whether a script has overlong lines.

    A rule may match where its kinds fit and the text has one of the rule's words
    or strings (see the catalog's tables) or, for a rule without any, its pattern.
    """
    asked = sorted({w for r in rules for w in NEEDS_WORD.get(r.id, "").split()})
    low = files.withColumn("_low", F.lower(F.col("text")))
    held = words_held(F.col("_low"), asked) if asked else F.array().cast("array<string>")
    low = settled(low, _held=held, _odd=F.col("text").rlike(RARE) & F.col("text").rlike(ODD))

    def may(r: Rule) -> Column:
        words, strings = NEEDS_WORD.get(r.id), NEEDS_STRING.get(r.id)
        tests = [F.arrays_overlap("_held", F.array(*[F.lit(w) for w in words.split()]))] if words else []
        tests += [F.col("_low").contains(x) for x in strings.split("|")] if strings else []
        if not tests:
            tests = [F.col("_odd")] if r.id in ODD_RULES else [F.col("text").rlike(NEEDS_PATTERN.get(r.id, f"(?m){r.pattern}"))]
        return F.col("kind").isin(*r.kinds) & _any(tests)

    found = F.filter(F.array(*[F.when(may(r), F.lit(i)) for i, r in enumerate(rules)]), lambda x: x.isNotNull())
    dense = (F.col("kind") == "script") & (F.length("text") >= LONGEST)
    marked = settled(low, may=found, hides=payloads.may_hide(F.col("text")), dense=dense)
    return marked.drop("_low", "_held", "_odd").filter((F.size("may") > 0) | F.col("hides") | F.col("dense"))


def candidates(files: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """files that some rule may match, with may (see gate)."""
    return gate(files, rules).filter(F.size("may") > 0).drop("hides", "dense")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def match_lines(files: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """A row for each match of a rule in a line: the line's columns, rule_ord, matched text and at (code points before it in the line). All matches of a line count.

    Only texts that some rule may match are cut into lines, and a line is tested
    against those rules alone.
    """
    return _match_lines(candidates(files, rules), rules)


def _match_lines(gated: DataFrame, rules: list[Rule]) -> DataFrame:
    lines = line_index(gated, keep=(*KEEP, "may"))

    def hit(r: Rule) -> Column:
        # what the gate asks of a text, the line has to hold itself
        needs = [*NEEDS_WORD.get(r.id, "").split(), *NEEDS_STRING.get(r.id, "|").split("|")]
        holds = [F.col("_low").contains(x) for x in needs if x]
        match = F.col("line_text").rlike(r.pattern)
        return _any(holds) & match if holds else match

    low = settled(lines, _low=F.lower("line_text"))
    hits = F.filter(F.col("may"), lambda k: one_of(k, [hit(r) for r in rules]))
    found = settled(low, _hits=hits).filter(F.size("_hits") > 0).withColumn("rule_ord", F.explode("_hits")).drop("may", "_low", "_hits")
    matches = one_of(F.col("rule_ord"), [F.regexp_extract_all("line_text", F.lit(r.pattern), F.lit(0)) for r in rules])
    pieces = one_of(F.col("rule_ord"), [F.split("line_text", r.pattern, -1) for r in rules])
    both = found.withColumns({"_matches": matches, "_pieces": pieces})
    each = settled(both, _places=found_at(F.col("_matches"), F.col("_pieces"))).withColumn("_at", F.explode("_places"))
    return each.select(*found.columns, "_at.matched", "_at.at")


def wrapped_matches(gated: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """As match_lines(), of gated texts: the matches of rules of wording that run over a line break within a paragraph. line is that of the first word, and line_text all lines of the match as one."""
    wording = [(i, r) for i, r in enumerate(rules) if r.quote_aware]
    if not wording:
        return _match_lines(gated.limit(0), rules)
    some = gated.filter(F.col("kind").isin("skill-md", "markdown", "text") & F.col("text").contains("\n"))
    places = F.filter(F.transform(F.col("may"), lambda k: one_of(k, [F.lit([i for i, _ in wording].index(n) if r.quote_aware else -1) for n, r in enumerate(rules)])), lambda k: k >= 0)
    rows = settled(some, _places=places, _flat=unwrapped(F.col("text"))).filter(F.size("_places") > 0)
    rows = text_matches(rows, [r.pattern for _, r in wording], "_places", "_flat")
    broken = F.filter("hits", lambda h: F.substring(F.col("text"), h["offset"] + 1, F.length(h["matched"])).contains("\n"))
    found = placed(rows.withColumn("hits", broken), keep=KEEP)
    ordinal = F.element_at(F.array(*[F.lit(i) for i, _ in wording]), F.col("rule") + 1)
    return found.select("file_id", *KEEP, "line", "line_text", ordinal.alias("rule_ord"), "matched", (F.col("column") - 1).alias("at"))


#: Calls and literals that hold a pattern to search for, not a command. Fixed values.
PATTERN_CALL = r"\bRegExp\s*\(|String\.raw`|\bre\.(?:compile|search|match|fullmatch|findall|finditer|sub|subn|split)\s*\(|\bregexp?\.MustCompile\s*\(|\bRegex\s*\("


def _in_pattern(before: Column, after: Column) -> Column:
    """Whether a match in code stands in a pattern: in a call that takes one, a raw string of Python, or a regular expression of JavaScript."""
    spoken = F.coalesce(F.col("lang"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)))
    raw = spoken.isin("python", "py", "python3", "pyw") & ((before.rlike(r"\b[rR][bB]?\"[^\"]*$") & after.contains('"')) | (before.rlike(r"\b[rR][bB]?'[^']*$") & after.contains("'")))
    literal = spoken.isin("javascript", "typescript", "js", "jsx", "ts", "tsx", "mjs", "cjs") & before.rlike(r"(?:^|[(,=:\[!&|?{};]|\breturn)\s*/(?![/*])(?:[^/\\\n]|\\.)*$") & after.rlike(r"^(?:[^/\\\n]|\\.)*/")
    return F.concat(before, F.col("matched"), after).rlike(PATTERN_CALL) | F.coalesce(raw | literal, F.lit(False))


def _quoted(before: Column, after: Column, single: Column) -> Column:
    """Whether a match stands within straight or curly quotation marks, or single ones where these count."""
    within = lambda q: ((F.regexp_count(before, F.lit(q)) - F.regexp_count(before, F.lit("\\\\" + q))) % 2 == 1) & after.contains(q)
    curly = before.rlike("\u201C[^\u201D]*$") & after.contains("\u201D")
    return within('"') | curly | (single & within("'"))


def grade(hits: DataFrame, decoded: bool = False) -> DataFrame:
    """hits, with region, lang and lead (see spans.contexts), with sev and conf after the ladder; skipped matches leave.

    In order: role, region, warning or quotation, comment, pattern or example,
    remote command, overlong script line, path. A mention takes one step of
    severity and all confidence. Decoded texts get no discount but that of the
    path: nobody encodes documentation.
    """
    rows = settled(hits, _before=F.expr("substring(line_text, 1, at)"), _after=F.expr("substring(line_text, at + length(matched) + 1)"))
    before, after = F.col("_before"), F.col("_after")
    markdown = F.col("kind").isin("skill-md", "markdown")
    shown = ~F.col("region").isin("hidden", "frontmatter")
    clause = F.regexp_extract(before, r"([^.;:!?\n]*)$", 1)
    rows = rows.filter(~(F.col("polarity") & shown & clause.rlike(NEGATES)))
    context = lambda *names: F.coalesce(F.col("path_context").isin(*names), F.lit(False)).cast("int")
    down, up, low = context("dev", "educational"), F.lit(0), context("container")
    if not decoded:
        role_effect = F.coalesce(F.try_element_at("roles", F.col("role")), F.lit("keep"))
        region_effect = F.when(markdown, F.coalesce(F.try_element_at("regions", F.col("region")), F.lit("keep"))).otherwise("keep")
        # the match's own words don't warn of it; what its line hangs on may
        caution = F.col("heeds_caution") & shown & markdown & (is_cautionary(F.concat(before, F.lit(" "), after)) | F.coalesce(is_cautionary(F.col("lead")), F.lit(False)))
        in_code = (F.col("kind") == "script") | (F.col("region") == "code")
        quoted = F.col("quote_aware") & shown & (markdown | (F.col("kind") == "script")) & _quoted(before, after, in_code)
        table = F.col("quote_aware") & markdown & (F.col("region") == "prose") & F.col("line_text").rlike(r"^\s*\|.*\|")
        comment = before.rlike(r"^\s*(?:#(?!!)|//|--|;|\*|<!--|REM\b)|\s#\s|\s//\s")
        example = before.rlike(r"(?i)\b(?:e\.g\.|for example|for instance|such as|i\.e\.)[^.;\n]{0,40}$")
        remote = before.rlike(r"(?i)\b(?:ssh|kubectl\s+exec|docker\s+(?:run|exec)|podman\s+(?:run|exec))\b[^;&|]*$")
        overlong = (F.col("kind") == "script") & (F.length("line_text") > 1000)
        described = F.col("polarity") & shown & clause.rlike(DESCRIBES)
        rows = settled(rows, _role=role_effect, _region=region_effect, _caution=caution, _quoted=quoted, _spoken=described, _data=in_code & (comment | _in_pattern(before, after) | example), _table=table, _remote=remote, _overlong=overlong)
        rows = rows.filter((F.col("_role") != "skip") & (F.col("_region") != "skip"))
        number = lambda c: F.coalesce(c, F.lit(False)).cast("int")
        effects = lambda name: number(F.col("_role") == name) + number(F.col("_region") == name)
        mention = ~F.col("_caution") & F.col("_quoted")
        down = down + number(F.col("_spoken")) + number(F.col("_caution")) + number(mention) + number(F.col("_data"))
        up = effects("raise")
        low = low + effects("lower-confidence") + number(~F.col("_caution") & ~F.col("_quoted") & F.col("_table")) + number(F.col("_remote")) + number(F.col("_overlong"))
    graded = rows.withColumns({"_down": down, "_up": up, "_low": low})
    sev = demote(promote(F.col("sev"), F.col("_up")), F.col("_down"))
    conf = F.when(F.col("_down") > 0, 0).otherwise(lower_confidence(F.col("conf"), F.col("_low")))
    return graded.withColumns({"sev": sev.cast("int"), "conf": conf.cast("int")}).drop("_down", "_up", "_low", "_role", "_region", "_before", "_after", "_caution", "_quoted", "_spoken", "_data", "_table", "_remote", "_overlong", "lead", "lang", "regions", "roles", "heeds_caution", "quote_aware", "polarity")


def scan(files: DataFrame, rules: list[Rule] = RULES, decoded: bool = False) -> DataFrame:
    """Graded matches of files (see as_files), at most each rule's number a file: those of the smallest lines. Rules that are signals alone make no findings and have no cap.

    Texts that may match and their matches are stored; context is looked up in
    those texts alone.
    """
    return _scan(stored(candidates(files, rules), "gated"), files, rules, decoded)


#: The rule that downloads which are saved and run belong to.
SAVED_AND_RUN = "exec/download-then-execute"


def _scan(gated: DataFrame, files: DataFrame, rules: list[Rule], decoded: bool = False) -> DataFrame:
    columns = ["file_id", *KEEP, "line", "line_text", "rule_ord", "matched", "at"]
    none = lambda name: F.lit(None).cast("int").alias(name)
    hits = _match_lines(gated, rules).unionByName(wrapped_matches(gated, rules)).select(*columns, none("_sev"), none("_conf"))
    ids = [r.id for r in rules]
    if SAVED_AND_RUN in ids:
        saved = download_hits(gated).withColumn("rule_ord", F.lit(ids.index(SAVED_AND_RUN)))
        hits = hits.unionByName(saved.select(*columns, F.col("sev").alias("_sev"), F.col("conf").alias("_conf")))
    hits = stored(hits, "hits")
    dev = hits.filter((F.col("path_context") == "dev") & (F.col("kind") != "text")).select("bundle_id").distinct()
    graded_in = hits if dev.isEmpty() else with_references(hits, files.join(dev, "bundle_id", "left_semi"))
    dim = F.broadcast(rules_table(gated.sparkSession, rules))  # as many rows as the catalog
    rows = graded_in.join(dim, "rule_ord").join(contexts(gated, hits), ["file_id", "line", "at"])
    rows = rows.withColumns({"sev": F.coalesce("_sev", "sev"), "conf": F.coalesce("_conf", "conf")}).drop("_sev", "_conf")
    capped = Window.partitionBy("file_id", "rule_ord").orderBy("line", "at")
    return grade(rows, decoded).withColumn("_n", F.row_number().over(capped)).filter((F.col("_n") <= F.col("most")) | F.col("rule_id").startswith("signal/")).drop("_n")


def signals(matches: DataFrame) -> DataFrame:
    """Capabilities observed with more than low confidence; rules that are signals alone count with any."""
    only = F.col("rule_id").startswith("signal/")
    return matches.filter(F.col("signal").isNotNull() & ((F.col("conf") > 0) | only)).select("bundle_id", F.col("signal").alias("tag"), F.col("path").alias("file"), "kind", "line", "matched")


def findings(matches: DataFrame) -> DataFrame:
    """Matches as findings with a bounded and revealed snippet in which every credential is masked."""
    text = mask_matches(F.col("line_text"), SECRETS)
    rows = matches.filter(~F.col("rule_id").startswith("signal/"))
    return rows.select(
        "bundle_id", "rule_id", "title", "category", "sev", "conf", "hard", F.col("path").alias("file"), "line", (F.col("at") + 1).alias("column"), clip(one_line(reveal_invisible(text)), SNIPPET).alias("snippet"), F.col("rule_ord").alias("ord"), F.lit("static").alias("source"),
    )


#: Order of strengths of a pair, strongest first, and severity and confidence of the two findings they make. Fixed values.
STRENGTHS = ["same-script", "same-snippet", "cross-script", "same-script-far", "cross-file"]
PAIR_GRADES = {
    "credential-read": ("correlation/credential-exfiltration", "Reads credentials and sends data out", [(4, 2), (3, 1), (3, 1), (3, 0), (2, 0)]),
    "env-dump": ("correlation/environment-exfiltration", "Dumps the environment and sends data out", [(3, 2), (3, 1), (2, 1), (2, 1), (2, 0)]),
}


def strongest_pairs(seen: DataFrame) -> DataFrame:
    """For each bundle and kind of source signal, its strongest pairing with a sending signal; first source line, then first sink line on ties.

    Pairs are reduced to the nearest sink of each source within a file before
    files meet, so a bundle's signals don't all pair with each other: across
    files only each file's first signal matters.
    """
    script = F.col("kind") == "script"
    sources = seen.filter(F.col("tag").isin(*PAIR_GRADES)).select("bundle_id", "tag", F.col("file").alias("f"), F.col("line").alias("l"), script.alias("s"))
    sinks = seen.filter(F.col("tag").isin("network", "network-send")).select("bundle_id", F.col("file").alias("g"), F.col("line").alias("m"), script.alias("t"))
    # within a file: the nearest sink before and after each source
    events = sources.select("bundle_id", "tag", F.col("f").alias("file"), F.col("l").alias("line"), "s", F.lit(None).cast("int").alias("sink")).unionByName(
        sinks.join(sources.select("bundle_id", "tag", F.col("f").alias("g")).distinct(), ["bundle_id", "g"]).select("bundle_id", "tag", F.col("g").alias("file"), F.col("m").alias("line"), F.col("t").alias("s"), F.col("m").alias("sink"))
    )
    w = Window.partitionBy("bundle_id", "tag", "file").orderBy("line")
    near = events.withColumns({"_b": F.last("sink", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "_a": F.first("sink", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))}).filter(F.col("sink").isNull())
    both = near.withColumn("m", F.explode(F.array_distinct(F.filter(F.array("_b", "_a"), lambda x: x.isNotNull()))))
    gap = F.abs(F.col("line") - F.col("m"))
    rank = F.when(F.col("s") & (gap <= 80), 0).when(~F.col("s") & (gap <= 3), 1).when(F.col("s"), 3)
    own = both.withColumn("rank", rank).filter("rank is not null").select("bundle_id", "tag", "rank", F.col("file").alias("f"), F.col("line").alias("l"), F.col("file").alias("g"), "m")
    first_source = sources.groupBy("bundle_id", "tag", "f", "s").agg(F.min("l").alias("l"))
    # two files at most of each sort of sink: the first one, or the second where the first is the source's own
    first_sink = sinks.groupBy("bundle_id", "g", "t").agg(F.min("m").alias("m")).withColumn("_n", F.row_number().over(Window.partitionBy("bundle_id", "t").orderBy("g"))).filter("_n <= 2").drop("_n")
    across = first_source.join(first_sink, "bundle_id").filter("f <> g").select("bundle_id", "tag", F.when(F.col("s") & F.col("t"), 2).otherwise(4).alias("rank"), "f", "l", "g", "m")
    best = own.unionByName(across).groupBy("bundle_id", "tag").agg(F.min(F.struct("rank", "f", "l", "g", "m")).alias("p"))
    return best.select("bundle_id", "tag", F.get(F.array(*[F.lit(x) for x in STRENGTHS]), F.col("p.rank")).alias("strength"), F.col("p.rank").alias("rank"), F.col("p.f").alias("file"), F.col("p.l").alias("line"), F.col("p.g").alias("sink_file"), F.col("p.m").alias("sink_line"))


def correlations(pairs: DataFrame) -> DataFrame:
    """Findings of the strongest pairs, at the source's line."""
    of = lambda k: F.when(F.col("tag") == "credential-read", PAIR_GRADES["credential-read"][k]).otherwise(PAIR_GRADES["env-dump"][k])
    table = lambda tag, k: F.array(*[F.lit(g[k]) for g in PAIR_GRADES[tag][2]])
    pick = lambda k: F.get(F.when(F.col("tag") == "credential-read", table("credential-read", k)).otherwise(table("env-dump", k)), F.col("rank"))
    return pairs.select(
        "bundle_id", of(0).alias("rule_id"), of(1).alias("title"), F.lit("exfiltration").alias("category"), pick(0).alias("sev"), pick(1).alias("conf"), F.lit(False).alias("hard"), "file", "line", F.lit(1).alias("column"),
        F.concat_ws(" ", F.lit("with"), F.concat_ws(":", "sink_file", "sink_line")).alias("snippet"), F.lit(10_000).alias("ord"), F.lit("static").alias("source"),
    )


#: Characters of a line, or of a line on average in a script of more than MEAN_OVER, from which on it is too dense. Fixed values.
LONGEST, MEAN, MEAN_OVER = 3000, 500, 5000


def minified(files: DataFrame) -> DataFrame:
    """Findings about scripts whose lines are too long to be read: one line of 3000 characters, or 500 on average over more than 5000."""
    size = F.transform(F.split(F.col("text"), "\n", -1), lambda x: F.length(x))
    rows = files.filter((F.col("kind") == "script") & (F.length("text") >= LONGEST)).withColumn("_sizes", size)
    longest, total = F.array_max("_sizes"), F.aggregate("_sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    found = rows.filter((longest >= LONGEST) | ((total / F.size("_sizes") > MEAN) & (total > MEAN_OVER)))
    return found.select(*_finding("obfuscation/minified-code", "Code too dense to be read", "obfuscation", F.lit(1), F.lit(1), False, F.array_position("_sizes", longest).cast("int"), F.concat(F.lit("longest line: "), longest.cast("string"))))


def _finding(rule: str, title: str, category: str, sev: Column, conf: Column, hard: bool, line: Column, snippet: Column, column: Column | None = None) -> list[Column]:
    return [
        F.col("bundle_id"), F.lit(rule).alias("rule_id"), F.lit(title).alias("title"), F.lit(category).alias("category"), sev.cast("int").alias("sev"), conf.cast("int").alias("conf"), F.lit(hard).alias("hard"), F.col("path").alias("file"),
        line.alias("line"), (F.lit(1) if column is None else column).alias("column"), snippet.alias("snippet"), F.lit(9000).alias("ord"), F.lit("static").alias("source"),
    ]


def payload_findings(grades: DataFrame) -> DataFrame:
    """Findings about virtual files that hide something (see payloads.payload_grades), at their outermost run's place. A critical one isn't open to doubt."""
    said = F.concat(F.col("encoding"), F.lit(" hides "), F.array_join("rules", ", "))
    columns = _finding("obfuscation/encoded-payload", "Encoded text that hides a risk", "obfuscation", F.col("sev"), F.col("conf"), False, F.col("line"), said, F.col("at") + 1)
    return grades.select(*[(F.col("sev") >= 4).alias("hard") if k == 6 else c for k, c in enumerate(columns)])


def hidden_matches(files: DataFrame, rules: list[Rule] = RULES, depth: int = payloads.DEPTH) -> tuple[DataFrame, DataFrame] | None:
    """Graded matches in all texts that files hide, at their places in the real files, and the grades of what hides them; None where nothing is hidden. A hidden text's path context is that of its real file, as far as nothing runs it."""
    virtual = payloads.virtual_files(files.select(*FILE), depth)
    if virtual is None:
        return None
    if not virtual.filter((F.col("path_context") == "dev")).isEmpty():
        light = virtual.select("file_id", "bundle_id", "path", F.xxhash64("bundle_id", "path").alias("_real"), "path_context")
        run = with_references(light.withColumnsRenamed({"file_id": "_virtual", "_real": "file_id"}), files.select(*FILE)).select(F.col("_virtual").alias("file_id"), F.col("path_context").alias("_context"))
        virtual = stored(virtual.join(run, "file_id").withColumn("path_context", F.col("_context")).drop("_context"), "virtual")
    matches = stored(scan(virtual.select(*FILE), rules, decoded=True), "hidden-matches")
    return payloads.relocated(matches, virtual), payloads.payload_grades(matches, virtual, depth)


def decoded_findings(files: DataFrame, rules: list[Rule] = RULES, depth: int = payloads.DEPTH) -> DataFrame:
    """Findings about encoded runs and invisible messages that hide something, at the run's place."""
    hidden = hidden_matches(files, rules, depth)
    if hidden is None:
        empty = files.limit(0).select("*", F.lit("").alias("encoding"), F.array(F.lit("")).alias("rules"), *[F.lit(0).alias(c) for c in ("sev", "conf", "line", "at")])
        return payload_findings(empty)
    return payload_findings(hidden[1])


FILE = ["bundle_id", "file_id", "path", "kind", "role", "path_context", "text"]


def scan_bundles(files: DataFrame, rules: list[Rule] = RULES, more: DataFrame | None = None) -> DataFrame:
    """All findings of files: matches, those in what they hide, correlations over both, unreadable code, encoded payloads and more (findings from elsewhere), without duplicates, the worst FINDINGS_PER_BUNDLE of each bundle."""
    kept = stored(gate(files.select(*FILE), rules), "gated")
    matches = stored(_scan(kept.filter(F.size("may") > 0), files.select(*FILE), rules), "matches")
    hidden = hidden_matches(kept.filter("hides"), rules)
    rows = minified(kept.filter("dense"))
    if hidden is not None:
        matches = matches.unionByName(hidden[0])
        rows = rows.unionByName(payload_findings(hidden[1]))
    rows = rows.unionByName(findings(matches)).unionByName(correlations(strongest_pairs(signals(matches))))
    if more is not None:
        rows = rows.unionByName(more)
    return worst(dedupe(rows), FINDINGS_PER_BUNDLE)
