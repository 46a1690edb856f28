"""Texts cut off by a field limit or a broken transfer.

Per source, the lengths of the texts (in characters and in bytes) are counted,
and lengths far more frequent than those around them are spikes: the limits of
fields. A value at such a length (or, where words are kept whole, just below)
that has no terminal punctuation is suspect. A limit does not prove a cut, and a
broken transfer has no fixed length, so the end of every text is read as well:
unfinished structure (tag, entity, code, table row, quoted code) is a cut of
itself; else the last word decides, by how often the corpus ends a line with it
(words that end no line, parts of words that are no word). These counts come
from all lines of all different texts, pre-aggregated where they are read: copies
count once, and no text counts for its own end.

Defined results: null, empty and blank texts are no case; a complete text at a
limit is no case; copies of a text are each reported; a null source is a source
of its own in the report; an empty table gives empty results; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage

#: Signs that something was left out, at the end of a line; an ellipsis alone may be the author's.
MARK = re.compile(
    r"[\[(<{]\s*(?:\.\.\.|…)?\s*(?:truncated|cut off|cut|snip(?:ped)?|continued|more|gekürzt|tronqué|truncado|output omitted|message clipped|clipped)\b[^\])>}]*[\])>}]$"
    r"|\[\s?(?:\.\.\.|…)\s?\]$|\(\s?(?:\.\.\.|…)\s?\)$",
    re.I,
)
RULED_MARK = re.compile(r"-\s?(?:more|truncated)\s?-+$", re.I)
AND_SO_ON = re.compile(r"(?:\b(?:so on|so forth|etc|and more|usw|und so weiter|u\. ?s\. ?w|et cetera|ainsi de suite|y así sucesivamente|etcétera)\.?)$", re.I)
_CLOSERS = "\"'”’»)]*_`"
_SMILE = re.compile(r"[:;]-?[)(DP]$|[♥✅👍🎉]$")
_POINTED = re.compile(r"(?:\b(?:e\.g|i\.e|z\.B|p\. ?ej|cf|vs)\.|/\w+\.|\s\d+\.)$")
_ENTITY = re.compile(r"&(?:#x?[0-9a-fA-F]{0,6}|[A-Za-z]{1,7})$")
_TAG = re.compile(r"</?(?:[A-Za-z][^<>]*)?$")
_ESCAPE = re.compile(r"\\u?[0-9a-fA-F]{0,3}$")
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.M)
_PATH = re.compile(r"^\(?[\w.@~-]*(?:/[\w.@~-]*)+$")
_EXT = re.compile(r"\.(\w{1,5})$")
_IDENT = re.compile(r"^_?[A-Za-z]+(?:_[A-Za-z0-9]+)+(?:\(\))?$|^[A-Z][a-z]+(?:[A-Z][a-z]+)+(?:\(\))?$")
_KEY = re.compile(r"^[\w]+(?:[-_][\w]+)+:$")
_NUM = re.compile(r"^[\d][\d.,:x-]*$")


def token_class(token: str) -> str:
    """A word as it is (in lower case), anything invented as its shape."""
    if not token:
        return ""
    end = ""
    if token[-1] in ".,;:!?" and len(token) > 1 and not _KEY.match(token):
        token, end = token[:-1], token[-1]
    if "`" in token:
        shape = "<code>" if token.count("`") % 2 == 0 and token[-1] in "`)" else "<open code>"
    elif "://" in token:
        shape = "<url/>" if token.split("://", 1)[1].count("/") else "<url>"
    elif _PATH.match(token):
        m = _EXT.search(token)
        shape = f"<path.{m.group(1).lower()}>" if m else "<path>"
    elif token.startswith("--"):
        shape = "<flag>"
    elif _KEY.match(token):
        shape = "<key:>"
    elif token[0] == "#" and token[1:].isdigit():
        shape = "<reference>"
    elif _NUM.match(token):
        shape = "<number>"
    elif _IDENT.match(token):
        shape = "<identifier>"
    else:
        shape = token.lower()
    return shape + end


_SPEAKER = re.compile(r"^\w{1,20}:\s+(?=[A-ZÀ-Þ¿¡\"'`(])")
_TRAILER = re.compile(r"^([A-Z][A-Za-z-]{1,24}):\s+(?:\S+\s+){0,3}(\S+)$")


def line_form(line: str) -> str:
    s = _SPEAKER.sub("", line.strip())
    if s.startswith("|"):
        return "row"
    if re.match(r"(?:[-*+•]|\d+[.)])\s", s):
        return "item"
    if s.startswith("#"):
        return "heading"
    if re.match(r"[\w.-]+\s*[:=]\s", s):
        return "setting"
    if len(s.split()) <= 3:
        return "short"
    return "prose"


def last_words(text: str, n: int) -> str:
    return " ".join(text.rsplit(None, n)[-n:])


def last_phrase(text: str | None) -> str:
    """The last three words, by which closing lines are known again."""
    return last_words(text or "", 3).lower()


def _unfinished(line: str) -> bool:
    """Whether a line ends within an entity, a tag or an escape."""
    if line[-1] == "\ufffd":
        return True
    return any((i := line.rfind(c)) >= 0 and form.match(line, i) is not None for c, form in (("&", _ENTITY), ("<", _TAG), ("\\", _ESCAPE)))


def _marked(line: str) -> bool:
    """Whether a line ends with a sign that something was left out."""
    if line[-1] in "])>}":
        at = max(line.rfind(c) for c in "[(<{")
        return at >= 0 and MARK.match(line, at) is not None
    return line[-1] == "-" and RULED_MARK.search(line) is not None


def terminal(t: str) -> bool:
    """Whether a text ends with the punctuation of a sentence, closed or not."""
    core = t.rstrip(_CLOSERS)
    return core[-1:] in tuple(".!?。！？") or _SMILE.search(t[-3:]) is not None


def read_end(text: str | None) -> tuple[str, str, str]:
    """(verdict, form, last token's class) of a text's end.

    The verdict is ``none`` (nothing there), ``done``, ``cut``, or ``open`` where the last word must decide.
    """
    t = (text or "").rstrip().rstrip("\u200b\ufeff\x00").rstrip()
    if not t:
        return "none", "", ""
    line = t[t.rfind("\n") + 1 :]
    if _unfinished(line):
        return "cut", "structure", ""
    if _marked(line):
        return "cut", "mark", ""
    dots = t.endswith("...") or t[-1] == "…"
    if dots:
        t = (t[:-1] if t[-1] == "…" else t.rstrip(".")).rstrip()
        if not t or AND_SO_ON.search(last_words(t, 4)):
            return "done", "", ""
        line = t[t.rfind("\n") + 1 :]
    fences = len(_FENCE.findall(t))
    if fences % 2:
        return "cut", "code", ""
    if fences and _FENCE.match(line):
        return ("cut" if dots else "done"), "code", ""
    form = line_form(line)
    if form == "row":
        above = [x.strip() for x in t.rsplit("\n", 2)[-2:-1] if x.strip().startswith("|")]
        whole = line.rstrip().endswith("|") and (not above or above[0].count("|") <= line.count("|"))
        return ("done" if whole and not dots else "cut"), form, ""
    if line.count("`") % 2:
        return "cut", "code", ""
    token = token_class(line.rsplit(None, 1)[-1])
    alone = t[: len(t) - len(line)].endswith("\n\n")
    if alone and (m := _TRAILER.match(line)):
        form, token = "trailer", f"{m.group(1).lower()}: {token}"
    if form == "prose" and alone and len(line.split()) <= 8:
        form = "closing"
    if terminal(t):
        return ("open" if _POINTED.search(" " + last_words(t, 2)) else "done"), form, token
    if dots:
        return "cut", form, token
    return "open", form, token


_OFTEN = 3  # other texts that close alike, from which on an end is a usual one if more than twice as many texts close with it as break off at it
_RARE = 20  # occurrences in different texts, below which a word proves nothing
_BLANK = " \t\n\r\f\v\x00\u00a0\u200b\ufeff"  # what copies may differ in at their end
_DOCS = "doc_id bigint, source string, n_chars bigint, n_bytes bigint, text_id string, verdict string, form string, token string, phrase string"
_WORDS = "token string, n_all bigint, n_end bigint"


def _read_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each text ends, beside its sizes."""
    for batch in batches:
        rows = []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            verdict, form, token = read_end(text)
            rows.append((verdict, form, token, last_phrase(text) if verdict == "open" and form in ("closing", "prose") else None))
        if rows:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.string()) for c in zip(*rows))], names=[c.split()[0] for c in _DOCS.split(", ")])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of words anywhere and at line ends (last lines apart), summed over a task's texts as far as they fit."""
    classes: dict[str, list[int]] = {}

    def give():
        out = pa.RecordBatch.from_arrays([pa.array(list(classes), pa.string()), *(pa.array([v[i] for v in classes.values()], pa.int64()) for i in (0, 1))], names=["token", "n_all", "n_end"])
        classes.clear()
        return out

    for batch in batches:
        every: Counter = Counter()
        ends: Counter = Counter()
        for text in batch.column(0).to_pylist():
            lines = text.rstrip().split("\n")
            every.update(" ".join(lines[:-1]).split())
            every.update(lines[-1].split()[:-1])
            ends.update([x[-1] for line in lines[:-1] if (x := line.rsplit(None, 1)[-1:])])
        for t, n in every.items():
            c = classes.setdefault(token_class(t), [0, 0])
            c[0] += n
            c[1] += ends.get(t, 0)
        if len(classes) > 200_000:
            yield give()
    if classes:
        yield give()


_SALTS = 16


def _beside(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join on a key of which a few values may hold most rows: the rows of a value are spread, the counts repeated for each share."""
    spread = left.withColumn("share", F.pmod(F.xxhash64("text_id", "doc_id"), F.lit(_SALTS)).cast("int"))
    repeated = right.withColumn("share", F.explode(F.array(*[F.lit(i) for i in range(_SALTS)])))
    # a merge: what the repeated counts take in memory cannot be told from the size of their file
    return spread.join(repeated.hint("merge"), [key, "share"], "left").drop("share")


def length_spikes(lengths: DataFrame, column: str, least: int = 5, times: float = 8.0, reach: float = 0.04, share: float = 0.003) -> DataFrame:
    """Lengths of a source that are far more frequent than the lengths around them: source, at_limit, n_at_limit.

    ``lengths``: source and ``column``. At least ``least`` values have the length, a ``share`` of the source's, and
    ``times`` the mean of the lengths within ``reach`` of it. Works on counts: as many rows as there are different lengths.
    """
    counted = lengths.where(F.col(column) > 20).groupBy("source", column).agg(F.count("*").alias("n"))
    at = F.col(column)
    bin_of = F.floor(F.log(at.cast("double")) / reach)
    binned = counted.withColumn("bin", bin_of)
    # the mean over a length's bin of lengths, without itself
    w = Window.partitionBy("source", "bin")
    width = F.greatest(F.lit(1.0), F.exp((F.col("bin") + 1) * reach) - F.exp(F.col("bin") * reach))
    rest = (F.sum("n").over(w) - F.col("n")) / width
    return (
        binned.withColumn("around", rest)
        .withColumn("texts", F.sum("n").over(Window.partitionBy("source")))
        .where((F.col("n") >= least) & (F.col("n") >= share * F.col("texts")) & (F.col("n") >= times * F.greatest("around", F.lit(0.5))))
        .select("source", F.col(column).alias("at_limit"), F.col("n").alias("n_at_limit"))
    )


def examine(documents: DataFrame, kept_words: int = 12) -> DataFrame:
    """Every text with ``is_cut`` and why: doc_id, source, n_chars, n_bytes, at_limit, reason, is_cut.

    The reason is ``length spike`` for a text at a spike length without terminal punctuation whose end is no usual one, else what its end shows.
    """
    text = F.col("text").cast("string")
    texts = documents.select(
        F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), F.md5(F.rtrim(text, F.lit(_BLANK))).alias("text_id"), text.alias("text"),
    )
    docs = stage(texts.mapInArrow(_read_ends, _DOCS), "ends")
    # copies meet before their words are counted: each map task sends one of them, so a text under many ids is no hot key
    different = texts.where("text is not null").groupBy("text_id").agg(F.any_value("text").alias("text")).select("text")
    tokens = different.mapInArrow(_count_words, _WORDS).groupBy("token").agg(F.sum("n_all").alias("n_all"), F.sum("n_end").alias("n_end"))
    open_docs = docs.where("verdict = 'open'")
    ends = open_docs.groupBy("text_id").agg(*(F.any_value(c).alias(c) for c in ("form", "token", "phrase")))
    # lines that stand alone at the end: closing words, trailers, links
    alone = F.col("form").isin("closing", "trailer", "short")
    open_ends = ends.groupBy("token").agg(F.count_if(alone).alias("n_last"), F.count_if(~alone).alias("n_broken"))
    stats = stage(open_ends.join(tokens, "token", "left"), "word_ends")
    phrases = ends.where("phrase is not null").groupBy("phrase").agg(F.count_if(alone).alias("n_phrase"), F.count_if(~alone).alias("n_broken_phrase"))
    spikes_c = length_spikes(docs, "n_chars")
    spikes_b = length_spikes(docs.where("n_bytes <> n_chars"), "n_bytes")
    # words kept whole end up to kept_words characters below the limit
    limits = spikes_c.select("source", F.explode(F.sequence(F.col("at_limit") - kept_words, F.col("at_limit"))).alias("n_chars")).distinct().withColumn("limit_c", F.lit(True))
    limits_b = spikes_b.select("source", F.explode(F.sequence(F.col("at_limit") - 3, F.col("at_limit"))).alias("n_bytes")).distinct().withColumn("limit_b", F.lit(True))
    # only texts whose last word must decide look it up; one without a phrase looks for none
    told_ends = _beside(_beside(open_docs, stats, "token").withColumn("phrase", F.coalesce("phrase", F.concat(F.lit("\0"), "text_id"))), phrases, "phrase")
    judged = (
        told_ends.unionByName(docs.where("verdict <> 'open'"), allowMissingColumns=True)
        .join(limits, ["source", "n_chars"], "left")
        .join(limits_b, ["source", "n_bytes"], "left")
        .withColumn("at_limit", F.coalesce("limit_c", "limit_b", F.lit(False)))
    )
    n_all, n_end = F.coalesce("n_all", F.lit(0)), F.coalesce("n_end", F.lit(0))
    # the other texts that end with the word on a line alone, or with the phrase: the judged one is among those counted
    n_last = F.coalesce("n_last", F.lit(0)) - F.when((F.col("verdict") == "open") & alone, 1).otherwise(0)
    # chance cuts within lines fall into prose and lists more often than onto a line alone, whatever the size of the table
    n_phrase = F.coalesce("n_phrase", F.lit(0)) - 1
    usual_phrase = (n_phrase >= _OFTEN) & (n_phrase > 2 * F.coalesce("n_broken_phrase", F.lit(0)))
    # a word that often ends whole texts, as in closing lines, counts as an end as well
    usual = F.when((n_last >= _OFTEN) & (n_last > 2 * F.coalesce("n_broken", F.lit(0))), n_last).otherwise(0)
    seen_at_all = F.greatest(n_all + n_last, F.lit(1))
    share, closing_share = (n_end + usual) / seen_at_all, usual / seen_at_all
    # a word seen, but too seldom to tell, proves nothing, unless the length is a limit's
    told = F.col("at_limit") | ~(n_all.between(1, _RARE - 1) & ~F.col("token").startswith("<"))
    end = (
        F.when(F.col("verdict") == "cut", F.concat(F.lit("unfinished "), "form"))
        .when((F.col("verdict") == "open") & F.col("form").isin("prose", "closing") & ((F.col("form") == "prose") | ((closing_share < 0.5) & ~usual_phrase)), "within a sentence")
        .when((F.col("verdict") == "open") & (F.col("form") != "closing") & told & (share < F.when(F.col("at_limit"), 0.05).otherwise(0.02)), "within a line")
    )
    return judged.withColumns({"end": end, "ends_share": share}).select(
        "doc_id", "source", "n_chars", "n_bytes", "at_limit", F.when(F.col("end").isNotNull() & F.col("at_limit"), "length spike").otherwise(F.col("end")).alias("reason"),
        F.col("end").isNotNull().alias("is_cut"), "end", "form", "token", "verdict", "ends_share",
    )


def cut_documents(documents: DataFrame) -> DataFrame:
    return examine(documents).where("is_cut").select("doc_id").distinct()


def source_report(documents: DataFrame) -> DataFrame:
    """Per source: texts, cut texts and their share, and how many of them are at a limit."""
    return examine(documents).where("verdict <> 'none'").groupBy("source").agg(
        F.count("*").alias("n_texts"),
        F.count_if("is_cut").alias("n_cut"),
        (F.count_if("is_cut") / F.count("*")).alias("share_cut"),
        F.count_if(F.col("is_cut") & F.col("at_limit")).alias("n_cut_at_limit"),
    )
