"""Text cleaning as chains of built-in expressions; the order of a chain is part of its meaning."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (pattern, replacement), applied in order. The dialect is what Java and RE2 share.
REDACTIONS = (
    (r"(?i)\b(password|passwd|secret|token|api_?key)\b[\"']?[ \t]*[:=][^\n]*", "[credential]"),
    (r"AKIA[A-Z0-9]{14,}", "[access-key]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[email]"),
    (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "[ip]"),
    (r"\+[0-9][0-9 ().-]{7,}[0-9]", "[phone]"),
    (r"\b[0-9]{13,19}\b", "[number]"),
)
INJECTIONS = ("ignore (?:all )?previous instructions", "disregard (?:the|your) (?:system|above)", "you are now", "system prompt", "act as (?:an?|the) ", "jailbreak", "do anything now", "reveal your")
#: utm_* and the seven keys that are no information; fixed values.
TRACKING = r"(?i:utm_[^=&#]*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid)"


def chain(text: Column, steps) -> Column:
    for pattern, with_ in steps:
        text = F.regexp_replace(text, pattern, with_.replace("\\1", "$1"))
    return text


def once(value: Column, body) -> Column:
    """body(value), with value computed once a row: what stands inside a lambda would run again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def redact(text: Column) -> Column:
    return chain(text, REDACTIONS)


def any_of(text: Column, patterns) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(patterns)), F.lit(False))


def strip_tracking(url: Column) -> Column:
    """The URL without tracking parameters; fragments stay."""
    out = F.regexp_replace(url, rf"([?&]){TRACKING}=[^&#]*", "$1")
    out = F.regexp_replace(out, r"&+", "&")
    out = F.regexp_replace(out, r"\?&", "?")
    return F.regexp_replace(out, r"[?&]+(#|$)", "$1")


HTML_STEPS = (
    (r"(?is)<!--.*?-->|<(?:script|style|noscript|template|svg|canvas|iframe)\b[^>]*>.*?</(?:script|style|noscript|template|svg|canvas|iframe)>", " "), (r"(?is)<nav[^>]*>.*?</nav>", " "),
    (r"(?s)<[^>]*>", " "), (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&amp;", "&"), (r"[ \t\r\n]+", " "), (r"^ | $", ""),
)


def strip_html(html: Column) -> Column:
    return chain(html, HTML_STEPS)


PLAIN_STEPS = ((r"\r\n?", "\n"), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"))


def plain(text: Column) -> Column:
    return F.trim(chain(text, PLAIN_STEPS))


def drop_adjacent_lines(text: Column) -> Column:
    """Non-blank lines that equal the line before them go."""
    kept = lambda lines: F.filter(lines, lambda x, i: (F.trim(x) == "") | (i == 0) | (x != F.get(lines, i - 1)))
    return F.array_join(once(F.split(text, "\n"), kept), "\n")


def operation_key(domain: Column, task: Column) -> Column:
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower(task), r"[0-9]+", "N"), r"[ \t\n\r]+", " "))
    return F.substring(F.sha1(F.concat(F.lower(domain), F.lit("::"), norm).cast("binary")), 1, 16)


class _Markdown(HTMLParser):
    SKIP = {"script", "style", "nav", "noscript", "template", "svg", "iframe"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.href: list[str] = []
        self.pre = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIP:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "table", "ul", "ol"):
            self.out.append("\n\n")
        elif tag in ("br", "tr"):
            self.out.append("\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag == "a":
            self.href.append(a.get("href") or "")
            self.out.append("[")
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag == "img" and a.get("alt"):
            self.out.append(a["alt"])

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif tag == "pre":
            self.pre = False
            self.out.append("\n```\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def to_markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """page_id, markdown, weak: an Arrow-batched map, as nesting is beyond regular expressions."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            html = b.column(1).to_pylist()
            md = [to_markdown(h) for h in html]
            weak = [len(h or "") >= 5000 and (len(m) < 300 or (("```" not in m and " | " not in m) and len(m) < 0.03 * len(h))) for h, m in zip(html, md)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(md, pa.string()), pa.array(weak, pa.bool_())], names=["page_id", "markdown", "weak"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, markdown string, weak boolean")


# Credentials, scrubbing and trust. Patterns and their order are those that results must agree with. A word's begin is
# written as what stands before it, captured, so that engines whose word boundary knows ASCII only agree with those that know Unicode.
CREDENTIALS = (
    (r"(?i)(^|[^\p{L}\p{N}_])(?:api[_-]?key|secret|token|password|passwd|pwd)\s*[:=]\s*\S[^\r\n]*", "\\1<redacted-credential>"),
    (r"sk-[A-Za-z0-9]{20,}", "<redacted-openai-key>"),
    (r"shppa_[A-Za-z0-9]{20,}", "<redacted-shopify-token>"),
    (r"shpat_[A-Za-z0-9]{20,}", "<redacted-shopify-token>"),
    (r"ghp_[A-Za-z0-9]{20,}", "<redacted-github-token>"),
    (r"(?s)-----BEGIN [A-Z ]+PRIVATE KEY-----.*?-----END [A-Z ]+PRIVATE KEY-----", "<redacted-private-key>"),
    (r"(^|[^\p{L}\p{N}_])eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\b", "\\1<redacted-jwt>"),
    (r"(^|[^\p{L}\p{N}_])(?:AKIA|ASIA)[0-9A-Z]{16}\b", "\\1<redacted-aws-key>"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "<redacted-email>"),
)
#: One pattern a tag, as the dialect that both engines share has no back-references.
HIDDEN = (
    (r"(?is)<think>.*?</think>", "<redacted-hidden-reasoning>"),
    (r"(?is)<thinking>.*?</thinking>", "<redacted-hidden-reasoning>"),
    (r"(?i)(^|[^\p{L}\p{N}_])(?:chain of thought|chain-of-thought|internal reasoning|private thoughts):[^\n\r]*", "\\1<redacted-hidden-reasoning>"),
)
#: What stands before a Unix path is captured, as the dialect has no look-behind.
SCRUB = (
    (r"(?i)git@(?:github|gitlab|bitbucket)\.com:[^\s]+|(?i)ssh://git@[^\s]+|(?i)https?://(?:[^\s/@]+@)?(?:www\.)?(?:github|gitlab|bitbucket)\.[^\s]+", "<repo>"),
    (r"(^|[^\p{L}\p{N}_])(?:sk-[A-Za-z0-9_-]{12,}|gh[opsu]_[A-Za-z0-9_]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})\b", "\\1<secret>"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "<email>"),
    (r"(^|[^\p{L}\p{N}_])(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b", "\\1<ip>"),
    (r"(^|[^\p{L}\p{N}_])(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "\\1<ip>"),
    (r"(^|[^\p{L}\p{N}_])[A-Za-z]:\\(?:[^\\\s,;:'\"]+\\?)+", "\\1<path>"),
    (r"(^|[^A-Za-z0-9_.-])/(?:Users|home|var|tmp|private|Volumes)/[^\s,;:'\"]+", "\\1<path>"),
)
NEEDLES = (
    r"(?i)\bignore\s+(?:all\s+|any\s+)?(?:previous|prior|above|earlier)\s+instructions?\b",
    r"(?i)\bdisregard\s+(?:all\s+|any\s+)?(?:previous|prior|above|earlier)\b",
    r"(?i)\byou\s+are\s+now\b.{0,40}\b(?:dan|do\s+anything\s+now|unrestricted|jailbroken)\b",
    r"(?i)\bnew\s+(?:system\s+)?(?:prompt|instructions?)\s*[:=]",
    r"(?i)<\s*/?\s*(?:system|assistant)\s*>",
    r"(?i)\bsystem\s+override\b",
    r"(?i)\bdeveloper\s+mode\b",
    r"(?i)\boverride\s+(?:your\s+|the\s+)?(?:safety|guard\s*rails?|instructions?)\b",
)
SHELL = r"[;|&`><\n\r]|\$\("
LEXICON = {
    "explicit_negative": ("this is broken", "doesn't work", "does not work", "not working", "completely broken", "useless", "garbage", "this failed", "it failed again", "nothing changed", "still broken", "worse than before"),
    "command_repeat_marker": ("again", "still", "yet again", "same error", "same failure", "keeps failing", "retrying", "looping"),
    "dissatisfaction": ("not what i asked", "you keep", "stop doing", "why did you", "that's wrong", "that is wrong", "you missed", "you ignored", "this isn't right", "this is not right", "not acceptable", "i don't want"),
    "correction": ("no, i said", "no i said", "i told you", "i already said", "read the request", "pay attention", "that's not the file", "that is not the file", "wrong file", "wrong command", "wrong approach", "start over"),
}
NON_CONTENT = r"(?is)<!--.*?-->|<(?:script|style|noscript|template|svg|canvas|iframe)\b[^>]*>.*?</(?:script|style|noscript|template|svg|canvas|iframe)>"
MARKDOWN_PLAIN = (
    (r"!\[([^\]]*)\]\([^)]+\)", "\\1"), (r"\[([^\]]+)\]\([^)]+\)", "\\1"), (r"(?m)^#{1,6}\s*", ""), (r"[`*_~>]", ""),
    (r"\r\n", "\n"), (r"\r", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"\A\s+", ""), (r"\s+\z", ""),
)
MARKDOWN_CLEAN = (
    (r"\r\n", "\n"), (r"\r", "\n"), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"    ```", "```"), (r"(?i)!\[(?:tracking|pixel|spacer|blank)?\]\([^)]+\)", ""), (r"\[\]\([^)]+\)", ""),
    (r"[ \t]+\n", "\n"), (r"[ \t]+\z", ""), (r"\n{4,}", "\n\n\n"),
)
SALIENT = r"(?i)error|exception|traceback|fail|failed|warning|blocked|missing|assert|timeout|retry"
DONE, VERIFIED = r"\b(?:done|complete|fixed)\b", r"\b(?:verif[a-z]+|tests? passed|ran the tests)\b"
CLAIMS, DENIES = r"\b(?:works|no error)\b", r"\b(?:failed|there was an error)\b"


def first_category(lowered: Column, lexicon) -> Column:
    out = None
    for name, phrases in lexicon.items():
        test = F.exists(F.array(*map(F.lit, phrases)), lambda p: lowered.contains(p))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def _clauses(query: str) -> list[tuple[str, bool]]:
    """(term, is a phrase) of a search text in order."""
    out: list[tuple[str, bool]] = []
    for phrase, word in re.findall(r'"([^"]+)"|(\S+)', query):
        if phrase.strip():
            out.append((phrase.strip().lower(), True))
        else:
            out += [(p, False) for p in re.split(r"[^0-9a-z_]+", word.lower()) if p]
    return out


def prefix_query(query: str) -> str:
    """Phrases in quotes, words as prefixes, joined by AND; the whole in quotes if nothing is left of it."""
    terms = ['"' + t.replace('"', '""') + '"' if phrase else t + "*" for t, phrase in _clauses(query)]
    return " AND ".join(terms) or '"' + query.strip().replace('"', '""') + '"'


def matches_prefix(text: Column, query: str) -> Column:
    low, out = F.lower(text), F.lit(True)
    for term, phrase in _clauses(query) or [(query.strip().lower(), True)]:
        out = out & (low.contains(term) if phrase else low.rlike("(^|[^0-9a-z_])" + term))
    return out


def clean_markdown(text: Column) -> Column:
    """Markup noise goes and lines that equal the one before; nothing else does."""
    kept = lambda lines: F.filter(lines, lambda x, i: (F.trim(x) == "") | (i == 0) | (F.trim(x) != F.trim(F.get(lines, i - 1))))
    return F.regexp_replace(F.array_join(once(F.split(chain(text, MARKDOWN_CLEAN), "\n"), kept), "\n"), r"\A[ \n]+|[ \n]+\z", "")


def markdown_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, block, part, digest, pin. docs: doc_id, t."""
    b = docs.select("doc_id", F.posexplode(F.split("t", r"\n\n+")).alias("b", "x")).filter(F.regexp_replace("x", "[ \n]+", "") != "")
    b = b.withColumn("l", F.split("x", "\n"))
    full = F.filter("l", lambda y: F.trim(y) != "")
    tab = (F.size(full) >= 3) & F.forall(full, lambda y: F.trim(y).startswith("|"))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 20)), lambda g: F.array_join(F.slice("l", (g * 20 + 1).cast("int"), F.lit(20)), "\n"))
    parts = F.when(tab, F.slice("l", F.lit(3), F.greatest(F.size("l"), F.lit(1)))).when(F.length("x") > 2000, groups).otherwise(F.array("x"))
    pin = F.when(tab, F.concat(F.col("l")[0], F.lit("\n"), F.col("l")[1]))
    u = b.select("doc_id", (F.col("b") + 1).cast("long").alias("block"), pin.alias("pin"), F.posexplode(parts).alias("i", "p")).filter(F.regexp_replace("p", "[ \n]+", "") != "")
    return u.select("doc_id", "block", (F.col("i") + 1).cast("long").alias("part"), F.sha2(F.col("p").cast("binary"), 256).alias("digest"), "pin")


def breadcrumbs(heads: DataFrame, key: str) -> DataFrame:
    """key, line, level, end_line, qualified_name. heads: key, line, level (1 to 6), name.

    Of each level the last heading so far holds, unless a later one of a lesser level has ended it.
    """
    by = Window.partitionBy(key).orderBy("line")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    h = heads.withColumns({f"_l{k}": F.last(F.when(F.col("level") == k, F.struct("line", "name")), ignorenulls=True).over(upto) for k in range(1, 7)})
    crumbs = []
    for k in range(1, 7):
        ended = F.lit(False)
        for j in range(1, k):
            ended = ended | F.coalesce(F.col(f"_l{j}.line") > F.col(f"_l{k}.line"), F.lit(False))
        crumbs.append(F.when((k <= F.col("level")) & ~ended, F.col(f"_l{k}.name")))
    end = F.coalesce(F.lead("line").over(by), F.max("line").over(Window.partitionBy(key)) + 1)
    return h.select(key, "line", "level", end.alias("end_line"), F.array_join(F.array_compact(F.array(*crumbs)), " > ").alias("qualified_name"))


def fold_runs(docs: DataFrame) -> DataFrame:
    """doc_id, t with runs of lines folded, over the array of a text's lines: where runs start, and their lengths by the next start."""
    lines = F.split("t", "\n")
    starts = once(lines, lambda ls: F.filter(F.transform(ls, lambda x, i: F.when((i == 0) | (x != F.get(ls, i - 1)), i)), lambda i: i.isNotNull()))
    d = docs.select("doc_id", lines.alias("l"), starts.alias("s"))
    size = lambda i, j: F.coalesce(F.get("s", j + 1), F.size("l")) - i
    line = lambda i: F.get(F.col("l"), i)
    folded = F.transform(
        "s",
        lambda i, j: F.when(F.trim(line(i)) == "", line(i)).when(size(i, j) >= 3, F.concat(line(i), F.lit(" (line repeated "), size(i, j), F.lit(" times)"))).when(size(i, j) == 2, F.concat(line(i), F.lit("\n"), line(i))).otherwise(line(i)),
    )
    return d.select("doc_id", F.array_join(folded, "\n").alias("t"))


def fold_logs(lines: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, run, first_line, last_line, omitted: neighbours whose digits aside are equal."""
    from tesserix.operators.sequences import runs

    r = runs(lines.withColumn("_shape", F.regexp_replace("line", "[0-9]+", "N")), [key], order, "_shape")
    at = F.struct(*order)
    return r.groupBy(key, F.col("island").alias("run")).agg(F.min_by("line", at).alias("first_line"), F.max_by("line", at).alias("last_line"), F.greatest(F.lit(0), F.count("*") - 2).alias("omitted"))


def error_signature(message: Column) -> Column:
    """Same for messages that differ in addresses and numbers only."""
    return F.substring(F.sha2(F.regexp_replace(F.regexp_replace(message, "0x[0-9A-Fa-f]+", "HEX"), "[0-9]+", "N").cast("binary"), 256), 1, 16)


def salient(text: Column, most: int = 1200) -> Column:
    """The first eight telling lines, two of the head and two of the tail, each once; the middle is trimmed beyond so many characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.rtrim(x)), lambda x: F.trim(x) != "")
    telling = F.filter(lines, lambda x: x.rlike(SALIENT))
    tail = F.slice(lines, F.greatest(F.size(lines) - 1, F.lit(1)), F.lit(2))
    out = F.array_join(F.array_distinct(F.concat(F.slice(telling, 1, 8), F.slice(lines, 1, 2), tail)), "\n")
    half = most // 2
    return F.when(F.length(out) <= most, out).otherwise(F.concat(F.substring(out, 1, half), F.lit("\n...<trimmed>...\n"), F.substring(out, F.length(out) - half + 1, F.lit(half))))


def snippets(hits: DataFrame, key: str, context: int) -> DataFrame:
    """key, line_start, line_end, hits, score. hits: key, i (line), n (lines of the text)."""
    by = Window.partitionBy(key).orderBy("i")
    gap = F.coalesce(F.col("i") - F.lag("i").over(by) > 2 * context + 1, F.lit(True))
    g = hits.withColumn("_new", gap.cast("int")).withColumn("_c", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    s = g.groupBy(key, "_c").agg(F.greatest(F.lit(1), F.min("i") - context).alias("line_start"), F.least(F.max("n"), F.max("i") + context).alias("line_end"), F.count("*").alias("hits"))
    return s.select(key, "line_start", "line_end", "hits", F.round(F.col("hits") / (F.col("line_end") - F.col("line_start") + 1), 6).alias("score"))


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "untitled").otherwise(s)


def short_hash(text: Column, length: int = 8) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def identifier_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), short_hash(text, 16))


def words_of_name(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.lower(F.regexp_replace(s, "_+", " "))


def duration(seconds: Column) -> Column:
    """45s, 12m, 1.5h, 128h."""
    s = F.greatest(F.lit(0), seconds)
    whole = lambda x: F.round(x).cast("long").cast("string")
    return F.when(s < 60, F.concat(F.floor(s).cast("string"), F.lit("s"))).when(s < 3600, F.concat(whole(s / 60), F.lit("m"))).when(s < 36000, F.format_string("%.1fh", s / 3600.0)).otherwise(F.concat(whole(s / 3600), F.lit("h")))


def token_count(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.2fM", n / 1_000_000.0)).when(n >= 1000, F.format_string("%.1fk", n / 1000.0)).otherwise(n.cast("string"))


def dollars(usd: Column) -> Column:
    return F.format_string("$%.2f", usd.cast("double"))


def seconds_saved(calls: Column, tokens: Column) -> Column:
    """Four and a half seconds a call, and a second for fifty tokens."""
    return F.greatest(F.lit(0), calls) * 4.5 + F.greatest(F.lit(0), tokens) / 50.0


def iso_seconds(text: Column) -> Column:
    """Seconds of an ISO time, UTC if it names no zone; null if it is none."""
    plain = F.regexp_replace(text, "Z$", "+00:00")
    zoned = F.when(plain.rlike(r"[+-]\d\d:\d\d$"), plain).otherwise(F.concat(plain, F.lit("+00:00")))
    return F.unix_seconds(F.try_to_timestamp(zoned, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def char_limit(length: Column, base: int, most: int) -> Column:
    """The base, grown with the logarithm of what is over it, up to a bound."""
    return F.when(length <= base, F.lit(base)).otherwise(F.least(F.lit(most), F.floor(base * (1 + F.log2(length / F.lit(float(base))))))).cast("long")


def holds(op: str, left: Column, value: object) -> Column:
    """One comparison of a fixed set, on text, numbers and arrays."""
    if op in ("truthy", "falsy"):
        truth = F.coalesce(left.cast("string"), F.lit("")).isin("", "0", "0.0", "false")
        return truth if op == "falsy" else ~truth
    if op == "in":
        return F.lit(value).contains(left) if isinstance(value, str) else left.isin(*value)
    if op in ("contains", "not_contains"):
        return left.contains(value) if op == "contains" else ~left.contains(value)
    if op in ("gt", "gte", "lt", "lte"):
        if isinstance(value, (str, bool)) or value is None:
            raise ValueError(f"{op} compares numbers")
        return {"gt": left > value, "gte": left >= value, "lt": left < value, "lte": left <= value}[op]
    if op in ("eq", "ne"):
        return left.eqNullSafe(value) if op == "eq" else ~left.eqNullSafe(value)
    raise ValueError(f"unknown comparison {op!r}")


def bigrams(rows: DataFrame, text: str) -> DataFrame:
    """rows with g, the distinct pairs of neighbouring words."""
    w = rows.withColumn("_w", F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0))
    pairs = F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.concat(F.get("_w", i - 1), F.lit(" "), F.get("_w", i)))
    return w.withColumn("g", F.when(F.size("_w") < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))).drop("_w")


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def monitors(turns: DataFrame, back: int = 5, like: float = 0.5) -> DataFrame:
    """conv_id, loop, skip, contradiction, composite. turns: conv_id, turn (consecutive), text."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    b = bigrams(turns, "text")
    best = F.greatest(*[F.coalesce(jaccard(F.col("g"), F.col(f"_{k}")), F.lit(0.0)) for k in range(1, back + 1)])
    b = b.withColumns({f"_{k}": F.lag("g", k).over(by) for k in range(1, back + 1)}).withColumn("best", F.when(F.col("_1").isNotNull(), best))
    s = b.groupBy("conv_id").agg(
        F.count_if(F.col("best") >= like).alias("like"), F.count("best").alias("pairs"), F.bool_or(F.col("text").rlike(DONE)).alias("done"), F.bool_or(F.col("text").rlike(VERIFIED)).alias("verified"),
        F.min(F.when(F.col("text").rlike(CLAIMS), F.col("turn"))).alias("claim"), F.max(F.when(F.col("text").rlike(DENIES), F.col("turn"))).alias("denial"),
    )
    loop = F.when(F.col("pairs") > 0, F.round(F.col("like") / F.col("pairs"), 6)).otherwise(F.lit(0.0))
    skip, back_ = F.when(F.col("done") & ~F.col("verified"), 1.0).otherwise(0.0), F.when(F.col("denial") > F.col("claim"), 1.0).otherwise(0.0)
    return s.select("conv_id", loop.alias("loop"), skip.alias("skip"), back_.alias("contradiction"), F.round(0.5 * loop + 0.3 * skip + 0.2 * back_, 6).alias("composite"))


def tracking_sql(url: str) -> str:
    """strip_tracking in the SQL of the twins."""
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({url}, '([?&]){TRACKING}=[^&#]*', '\\1', 'g'), '&+', '&', 'g'), '\\?&', '?', 'g'), '[?&]+(#|$)', '\\1', 'g')"
