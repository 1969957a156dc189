"""Removal of repeated runs of words, by winnowing.

A word goes if it lies in a window of ``min_words`` words that also stands at an
earlier place, in the order of doc_id and place.  The union of these windows is
every run of ``min_words`` words or more that came before, wherever it starts
and ends, and whatever else its parts occur in.

Hashing every window would make a row of each word, so a window first gets a
fingerprint: the leftmost of the ``GRAM``-word grams that start in it with a pair
of words of the lower class, which is one in ``RARE`` by hash; a window without
one has its own first gram.  Equal windows have equal fingerprints, and
neighbouring windows mostly share theirs: they are a span, which makes one row
with a hash of all its words.  A span whose words stand at an earlier place is deleted whole.  Where a
fingerprint has spans with different words, windows may be equal though spans
aren't, as at the ends of a repeated run: of such spans' first occurrences the
windows are hashed themselves, and joined to their own first occurrence.  Two
windows of one span are never equal, as the fingerprint lies elsewhere in them.

Everything is DataFrame expressions.  A span or window is joined to one first
occurrence, never to all others, so a passage in a third of all documents makes
as many rows as it has copies; aggregations before are partial, and both sides
of a join on hashes are saved tables, whose hot keys Spark can split.  Such joins
are by merging at any size, so that work and disk grow with the input; a table
goes as soon as no later step reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, discard, save

#: A line begins after a newline, after a sentence's end and a space, and at a capital letter after a space.
CUT = r"(?<=\n)|(?<=[.!?]\s)|(?<=\s)(?=\p{Lu})"
#: The same places by what stands before them, which is faster to look for; needs a mark that isn't in the text.
ENDS, MARK = r"[.!?]\s|\s(?=\p{Lu})|\n", "\x01"
MIN_WORDS = 40
#: Words in a row that a fingerprint goes over, and those of them it is made of.
GRAM, PICKED = 12, (0, 2, 5, 8, 11)
#: Of so many pairs of words one is of the lower class; a power of 2.
RARE = 8
#: Rows of up to 16 bytes that may be broadcast; with more, the other side is shuffled too.
FEW = 2_000_000
_BLANK = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    marked = F.split(F.regexp_replace(text, ENDS, f"$0{MARK}"), MARK, -1)
    return F.when(F.instr(text, MARK) > 0, F.split(text, CUT, -1)).otherwise(marked)


def _keyed(docs: DataFrame) -> DataFrame:
    """The row as a struct, so that its column names can't clash, with its order, text and text's hash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), body("row.text").alias("text")
    ).withColumn("th", F.hash("text"))


def _words(text: Column) -> Column:
    rare = "[" + "".join(_BLANK[1:]).replace("\n", "") + "]"
    plain = F.when(text.rlike(rare), F.translate(text, _BLANK[1:], " " * len(_BLANK[1:]))).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.array_remove(F.split(plain, " "), "")


def _part(array: str, first: str, last: str) -> str:
    """Elements ``first`` to ``last`` of an array; ``slice`` would copy the whole array first."""
    return f"transform(sequence({first}, {last}), e -> {array}[e])"


def _hashes(text: Column) -> Column:
    """The words' hashes, which stand for them from here on."""
    return F.transform(_words(text), lambda x: F.xxhash64(x))


def _places(keyed: DataFrame):
    """The function that makes a place one number, whose least an aggregation can keep in place: a long if ids fit into 31 bits, else a decimal."""
    low, high = keyed.agg(F.min("d"), F.max("d")).first()
    if low is None or (low >= 0 and high < 1 << 31):
        return lambda d, pos: F.shiftleft(d, 32).bitwiseOR(F.col(pos).cast("long"))
    return lambda d, pos: (F.col(d).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col(pos)).cast("decimal(38,0)")


def _spans(keyed: DataFrame, n: int) -> DataFrame:
    """d, th, from, to, fp, c: spans of windows [from, to] of ``n`` words, their fingerprint, a hash of their words."""
    k = min(GRAM, n)
    w = n - k + 1  # grams that start in a window
    # places of the pairs of the lower class where a gram fits, then the first place where none does
    marks = f"concat(filter(sequence(0, size(w) - {k}), i -> ((w[i] ^ shiftright(get(w, i + 1), 8)) & {RARE - 1}) = 0), array(size(w) - {k - 1}))"
    rows = keyed.select("d", "th", _hashes(F.col("text")).alias("words"))
    # w is bound in a lambda: as a column it could be put in its place and then be made anew for each element
    found = f"transform(array(words), w -> if(size(w) >= {n}, named_struct('words', w, 'marks', {marks}), null))[0]"
    rows = rows.select("d", "th", F.expr(found).alias("u")).select("d", "th", "u.words", "u.marks")
    # all that follows is compiled, as no expression with a lambda comes after; outer, as else the planner makes each array a second time to filter empty ones
    rows = rows.select("d", "th", "words", "marks", F.posexplode_outer("marks").alias("j", "at")).where("at is not null")
    rows = rows.select("d", "th", "words", "at", F.expr("if(j > 0, marks[j - 1], -1) + 1").alias("a"), F.expr(f"at - {w - 1}").alias("own"))
    # windows from a that end before the mark have none and their own start; the last of these numbers is for the mark itself
    rows = rows.select("d", "th", "words", "at", "a", "own", F.explode_outer(F.expr("if(own > a, sequence(a, own), array(own))")).alias("i"))
    rows = rows.select(
        "d", "th", "words", F.expr("greatest(a, i)").alias("from"), F.expr(f"if(i = own, least(at, size(words) - {n}), i)").alias("to"), F.expr("if(i = own, at, i)").alias("at")
    ).where("from <= to")
    gram = ", ".join(f"get(words, at + {j})" for j in PICKED if j < k)
    return rows.select("d", "th", "from", "to", F.expr(f"xxhash64({gram})").alias("fp"), F.expr(f"xxhash64(slice(words, from + 1, to - from + {n}))").alias("c"))


def _having(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is in the saved table ``keys`` of whole numbers."""
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, keys.columns, "left_semi")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, th and ``runs``, an array of [from, to) word numbers to delete, of the rows that have any."""
    n, keyed = int(min_words), _keyed(docs).select("d", "th", "text")
    at = _places(keyed)
    spans = save(_spans(keyed, n), "spans")
    often = save(spans.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "often", light=True)
    again = save(_having(spans, often), "again")
    discard(spans, often)
    texts = again.groupBy("fp", "c").agg(F.min(at("d", "from")).alias("x"), F.count(F.lit(1)).alias("copies"))
    firsts = save(texts, "texts", light=True)
    several = save(firsts.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("fp", F.lit(True).alias("ask")), "several", light=True)
    texts = firsts.join(several.hint("merge"), "fp", "left").where("copies > 1 or ask").select("fp", "c", "x", F.coalesce("ask", F.lit(False)).alias("ask"))
    later = at("d", "from") > F.col("x")
    kinds = save(texts, "kinds", light=True)
    found = again.join(kinds.hint("merge"), ["fp", "c"]).select("d", "th", "from", "to", later.alias("later"), "ask").where("later or ask")
    found = save(found, "found", light=True)
    discard(again, firsts, several, kinds)
    asked = save(found.where("not later").groupBy("d", "th").agg(F.collect_set(F.struct("from", "to")).alias("spans")), "asked", light=True)
    rows = _having(keyed, asked.select("d", "th")).join(asked.hint("merge"), ["d", "th"]).select("d", "th", "spans", _hashes(F.col("text")).alias("words"))
    rows = rows.select("d", "th", "words", F.explode_outer("spans").alias("s")).select("d", "th", "words", F.explode_outer(F.expr("sequence(s.from, s.to)")).alias("pos"))
    windows = save(rows.select("d", "th", "pos", F.expr(f"xxhash64(slice(words, pos + 1, {n}))").alias("win")), "windows")
    first = windows.groupBy("win").agg(F.min(at("d", "pos")).alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = save(first, "first", light=True)
    late = windows.join(first.hint("merge"), "win").where(at("d", "pos") > F.col("x")).select("d", "th", F.col("pos").alias("from"), F.col("pos").alias("to"))
    gone = found.where("later").select("d", "th", "from", "to").unionAll(late).groupBy("d", "th").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("at"))
    runs = gone.select("d", "th", F.expr(f"""
        transform(array(at), p -> zip_with(
          filter(p, (x, i) -> i = 0 or x.from > p[i - 1].to + {n}), filter(p, (x, i) -> i = size(p) - 1 or p[i + 1].from > x.to + {n}),
          (x, y) -> named_struct('from', x.from, 'to', y.to + {n})))[0]""").alias("runs"))  # fmt: skip
    runs = save(runs, "runs", light=True)
    discard(found, asked, windows, first)
    return runs


def _pieces(text: Column) -> Column:
    """The words with the blanks after them; blanks before the first word are a piece of their own."""
    # a mark after each space and newline, which is fast, will do where no two blanks meet
    marked = F.replace(F.replace(text, F.lit(" "), F.lit(f" {MARK}")), F.lit("\n"), F.lit(f"\n{MARK}"))
    other = f"[{_BLANK}]{{2}}|[\t\x0b\x0c\r]|{MARK}"
    return F.when(text.rlike(other), F.split(text, f"(?<=[{_BLANK}])(?=[^{_BLANK}])", -1)).otherwise(F.array_remove(F.split(marked, MARK, -1), ""))


def _marked(docs: DataFrame, min_words: int) -> DataFrame:
    """The keyed rows with ``runs`` (null: none) and ``kept``, what is left of the text."""
    keyed = _keyed(docs).drop("text")  # it is in the row; twice through the shuffle would be too much
    runs = repeated_runs(docs, min_words)
    keys = runs.select("d", "th")
    if keys.count() <= FEW:  # only texts with runs are shuffled
        rest = keyed.join(F.broadcast(keys), ["d", "th"], "left_anti").withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType))
        joined = keyed.join(F.broadcast(keys), ["d", "th"], "left_semi").join(runs.hint("merge"), ["d", "th"])
    else:
        rest, joined = None, keyed.join(runs.hint("merge"), ["d", "th"], "left")
    joined = joined.withColumn("text", body("row.text"))
    # lead: whether the first piece is blank, so that word i is piece i + 1
    kept = F.expr("""transform(array(pieces), u -> transform(array(if(btrim(u[0], '{blank}') = '', 1, 0)), lead -> array_join(flatten(
        transform(sequence(0, size(runs)), j -> transform(array(named_struct('a', if(j = 0, 0, get(runs, j - 1).to + lead), 'b', coalesce(get(runs, j).from + lead, size(u)))), r ->
          if(r.b > r.a, {part}, cast(array() as array<string>)))[0])), ''))[0])[0]""".format(blank=_BLANK, part=_part("u", "r.a", "r.b - 1")))  # fmt: skip
    joined = joined.withColumn("pieces", F.when(F.col("runs").isNotNull(), _pieces(F.col("text"))))
    joined = joined.select("row", "text", "runs", F.when(F.col("runs").isNull(), F.col("text")).otherwise(kept).alias("kept"))
    return joined if rest is None else joined.unionAll(rest.select("row", body("row.text").alias("text"), "runs", body("row.text").alias("kept")))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with the repeated runs cut out of ``text`` (and ``n_chars`` brought up to date).

    A row of which nothing but blanks is left is dropped; a row that has lost
    nothing stays as it is, with a null or empty text too.  Rows with a null
    doc_id come after all others.  Rows that share a doc_id count as one
    document: what stands at the same place in them stays.  All columns are
    kept whatever their names; no rows give none.
    """
    out = _marked(docs, min_words).where(F.col("runs").isNull() | (F.btrim("kept", F.lit(_BLANK)) != ""))
    new = {"text": F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.col("kept"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("runs").isNull(), F.col("row.n_chars")).otherwise(F.length("kept").cast(kind))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, removed_lines (those of which all words went), removed_chars, kept_chars, kept_sha256 of every row."""
    rows = _marked(docs.select("doc_id", "text"), min_words).withColumn("sizes", F.when(F.col("runs").isNotNull(), F.transform(_lines(F.col("text")), lambda x: F.size(_words(x)))))
    # a blank line goes if words on both sides of it do
    whole = "exists(runs, r -> if(x > 0, a.at >= r.from and a.at + x <= r.to, a.at > r.from and a.at < r.to))"
    lines = F.expr(f"aggregate(sizes, named_struct('at', 0, 'n', 0), (a, x) -> named_struct('at', a.at + x, 'n', a.n + if({whole}, 1, 0)), a -> a.n)")
    rows = rows.select("row", "text", "kept", F.coalesce(lines, F.lit(0)).alias("n"))
    return rows.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.col("n").cast("long").alias("removed_lines"),
        (F.length("text") - F.length("kept")).cast("long").alias("removed_chars"), F.length("kept").cast("long").alias("kept_chars"), F.sha2("kept", 256).alias("kept_sha256"),
    )
