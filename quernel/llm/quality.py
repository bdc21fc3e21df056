"""Text statistics of documents, and whether a text is natural prose.

A text is a sequence of lines; every statistic is a sum over lines, so a chunk of a text reduces to a
small state that merges associatively with its neighbours' (see ``State``). A chunk may start and end
inside a line or a word: the state keeps its unfinished first and last line as text, and a merge
finishes the line in the middle. A short line takes the
kind of the line before it, so the finished lines are kept once for each kind the line before the chunk
may have had. A line without a break is put together before it is classified, so a text that is one line is finished by
one task. Texts over ``CHUNK`` characters are cut in the JVM and their states merged in a tree of
``FAN_IN``, while the repeats of their lines are counted by a shuffle on (text, line), so that no state grows
with the lines of its text; shorter texts need no shuffle.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.plans.cluster import spill_table
from quernel.sources.tables import table

CHUNK, FAN_IN = 32_768, 16
#: A line is repeated from so many occurrences on.
REPEATS = 4
#: The characters that Python's ``str.strip`` and ``str.split`` take as blank, as a class of Java's regular expressions.
BLANK = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

#: Common words of the four languages (fixed values).
COMMON = {
    "en": "a about after again all also although always am an and another any are as at away be because been before being both but by can could did do does doing each every for from get give got had has have having he her here him himself his how however i if in into is it its itself just keep keeps made make makes many may maybe me might much must my need needs never no nobody none not nothing now of often on once one only or other our out over people please really same shall she should since so some somebody someone something soon still take takes than that the their them then there these they think this those though through to too two under until up upon us usually very was way we well went were what when where whether which while who whom whose why will with within without would yes yet you your",
    "de": "aber alle allem allen aller alles als also am an andere anderen auch auf aus bei beim bevor bin bis bist da dabei dafür daher damit danach dann das dass dazu dein dem den denn der des dessen deshalb die dies diese diesem diesen dieser dieses doch dort du durch ein eine einem einen einer eines einmal er erst es etwas euch für gegen genug gerade gibt hat hatte hatten haben hast hier hin hinter ich ihm ihn ihnen ihr ihre im immer in ist ja jede jedem jeden jeder jedes jetzt kann kein keine keinen können lang lässt man mehr mein mich mir mit muss müssen nach nicht nichts noch nun nur ob oder ohne schon sehr sein seine seinem seinen seiner seit selbst sich sie sind so solange soll sollte sollten sondern soweit um und uns unser unter viel vom von vor wann war waren warum was weil wenn wer werden wie wieder wir wird wo wohl wollen wurde wurden würde zu zuerst zum zur zuvor zwar zwischen",
    "fr": "à afin ai ainsi alors après as au aucun aussi autre autres aux avait avant avec avoir bien c car ce ceci cela celle celui ces cet cette chaque chez comme comment contre d dans de depuis des dès deux doit donc dont du elle elles en encore entre es est et étaient était été être eu eux faire fait faut font il ils j je jusqu l la là le les leur leurs lorsque lui m ma mais me même mes mieux moins mon n ne ni non nos notre nous on ont ou où par parce pas pendant peu peut plus plutôt pour pourquoi pouvoir pu puis qu quand que quel quelle qui quoi rien s sa sans sait se sera ses seulement si soit son sont sous souvent sur t ta tandis te tes toi ton toujours tous tout toute toutes très trop tu un une va vaut vers vois vont vos votre vous y",
    "es": "a además al algo algunos antes aquí así aún aunque bajo bien cada casi como con contra cosa cual cuando cuyo da dar de debe deben del desde después donde dos durante e el él ella ellas ellos en entonces entre era eran es esa ese eso esta está están estaba estas este esto estos fue fueron ha haber había hace hacer han hasta hay he la las le les lo los más mas me mejor menos mi mientras mis mismo mucho muy nada ni ningún ninguno no nos nosotros nuestra nuestro nunca o otra otro para parece pero poco por porque pues puede pueden que qué queda quien se sea según ser si sí sido siempre sin sino sobre solo sólo son su sus también tan tanto te tener tiene tienen toda todas todavía todo todos tu tus un una uno unos usted va vez y ya yo",
}
COMMON_WORDS = frozenset(w for text in COMMON.values() for w in text.split())

#: A line is prose from this share of common words on, over at least so many words.
PROSE_SHARE, PROSE_WORDS = 0.19, 4
_WORD = re.compile(r"[^\W\d_][\w]*(?:['’][^\W\d_]+)*|[\d_]+")
ENCODED_RUN = 36
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{%d,}" % ENCODED_RUN)
_QUOTE = re.compile(r"^\s*(?:>\s?)+")
_CODE = re.compile(r"`[^`\n]{1,120}`")
_LIST = re.compile(r"^\s*(?:[-*+•·–—]+|\(?\d{1,4}[.)]|\(?[a-zA-Z][.)]|\[[ xX]\])\s+")
_SENTENCE_END = re.compile(r"[.!?…:;][\"'»”’)\]*_`]*$")
_KEY = re.compile(r"^\s*[\w.$-]+\s*[:=]\s*\S")
_GARBLED = re.compile("[\u0080-\u009f\u00a2\u00a4\u00a6\u00a7\u00a8\u00a9\u00ac\u00ae\u00af\u00b0-\u00b8\u00bc-\u00be\u20ac\u2122\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u02c6\u02dc\ufffd\u00c2\u00c3\u00e2\u00d0\u00d1\u00cc\u00cb]")
_MACHINE = re.compile(r"^\s*(?:at\s+\S+\s*\(|\d{4}-\d\d-\d\d[T ]\d\d:\d\d|[0-9a-f]{6,16}[: ]\s*(?:[0-9a-f]{2,8}\s+){2})|\[(?:ERROR|WARN|INFO|DEBUG|TRACE)\]")
_CSV = re.compile(r"[\w\"'.)-][,;](?=[\w\"'(.-])")
_SYMBOL = re.compile(r"[\W_]")
_SPLIT = re.compile(r"\S+")

KINDS = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)
#: What the line before can have been: none (start or blank line), prose, anything else.
NONE, AFTER_PROSE, AFTER_OTHER = range(3)


def _words(text: str) -> list[str]:
    return [w for w in _WORD.findall(text) if w[0].isalpha()]


def classify(line: str, before: int, words: list[str] | None = None, lower: list[str] | None = None, solid: int = 0) -> tuple[int, int]:
    """Kind of a non-blank line after a line of the given kind, and the kind the next line sees.

    ``words``, ``lower`` and ``solid``: the line's words, in lower case too, and its number of non-blank characters, where the caller has them.
    """
    quote = _QUOTE.match(line)
    bare = line[quote.end() :] if quote else line
    if not bare.strip():
        return PROSE, NONE
    text = bare
    if "`" in bare:
        text = _CODE.sub(" ", bare)
    if words is None or quote or text is not bare:
        words, solid = _words(text), len("".join(text.split()))
        lower = [w.lower() for w in words]
    common = sum(map(COMMON_WORDS.__contains__, lower))
    if "'" in text:
        common += sum(w.split("'")[0] in COMMON_WORDS for w in lower if "'" in w and w not in COMMON_WORDS)
    solid = solid or 1
    letters = sum(map(len, words))
    garbled = 0 if text.isascii() else len(_GARBLED.findall(text))
    encoded = sum(map(len, _ENCODED.findall(text))) if solid >= ENCODED_RUN and max(map(len, text.split())) >= ENCODED_RUN else 0
    marked = _LIST.match(bare)
    if garbled > 0.08 * solid and garbled >= 4 or 2 * encoded > solid or _MACHINE.match(bare):
        return JUNK, AFTER_OTHER
    if bare.count("|") >= 2 and (bare.lstrip()[0] == "|" or bare.count("|") >= 3) or bare.count("\t") >= 2:
        return TABLE, AFTER_OTHER
    if bare.count(",") + bare.count(";") >= 3 and len(_CSV.findall(bare)) >= 3:
        return TABLE, AFTER_OTHER
    if len(words) >= PROSE_WORDS and common >= PROSE_SHARE * len(words) and letters >= 0.62 * solid:
        return PROSE, AFTER_PROSE
    if marked:
        return LIST, AFTER_OTHER
    if before == AFTER_PROSE and len(words) <= 8 and letters >= 0.5 * solid and not _KEY.match(bare):
        return PROSE, AFTER_PROSE
    if common and letters >= 0.62 * solid and len(words) < PROSE_WORDS + 3 and _SENTENCE_END.search(bare.rstrip()):
        return PROSE, AFTER_PROSE
    if re.match(r"^\s*#{1,6}\s+\S", bare):
        return PROSE, NONE
    fields = bare.count(",") + bare.count(";")
    digits = sum(c.isdigit() for c in text)
    if fields >= 3 and len(words) <= 3 * (fields + 1):
        return (TABLE if digits else LIST), AFTER_OTHER
    if _KEY.match(bare) or re.search(r"\.{3,}\s*\d+\s*$", bare):
        return LIST, AFTER_OTHER
    if digits and len(_SPLIT.findall(bare)) >= 3 and re.search(r"\s{2,}", bare.strip()):
        return TABLE, AFTER_OTHER
    if letters < 0.5 * solid:
        return JUNK, AFTER_OTHER
    return (LIST if len(words) <= 6 else JUNK), AFTER_OTHER


#: The plain sums of a state.
SUMS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_solid", "n_common", "n_lines", "n_punct_lines")


def _sums(text: str, words: list[str] | None = None, lower: list[str] | None = None) -> list[int]:
    """Sums over finished words and characters of a piece of one or more lines; lines are counted elsewhere."""
    if words is None:
        words = _words(text)
        lower = [w.lower() for w in words]
    solid = "".join(text.split())
    return [len(text), len(words), sum(map(len, words)), len(_SYMBOL.findall(solid)), len(solid), sum(map(COMMON_WORDS.__contains__, lower)), 0, 0]


class State:
    """What a run of characters adds to its text.

    head, tail: the unfinished first and last line; where the run has no line break, all is head and
    ``tail`` is None. Only unfinished lines are kept as text.
    sums: over all that isn't in head or tail. by: for each kind of line before, the non-blank characters
    per kind and the kind the next line sees. lines: every finished line, as hash -> (times, characters),
    or None where lines are counted elsewhere.
    """

    __slots__ = ("by", "head", "lines", "sums", "tail")

    def __init__(self, text: str, counted: bool = True):
        self.sums, self.by, self.lines = [0] * len(SUMS), [[[0] * 4, k] for k in range(3)], {} if counted else None
        parts = text.split("\n")
        self.head, self.tail = parts[0], parts[-1] if len(parts) > 1 else None
        for line in parts[1:-1]:
            self._finish(line)

    def _finish(self, line: str) -> None:
        """Add a whole line."""
        words = _words(line)
        lower = [w.lower() for w in words]
        sums = _sums(line, words, lower)
        sums[0] += 1
        bare = line.strip()
        if bare:
            sums[6], sums[7] = 1, bool(_SENTENCE_END.search(bare))
            if self.lines is not None:
                self._repeat(hash_line(bare), 1, sums[4])
        self.sums = [a + b for a, b in zip(self.sums, sums, strict=True)]
        cache: dict[int, tuple[int, int]] = {}
        for own in self.by:
            if not bare:
                own[1] = NONE
            else:
                kind, after = cache.setdefault(own[1], None) or classify(line, own[1], words, lower, sums[4])
                cache[own[1]] = kind, after
                own[0][kind] += sums[4]
                own[1] = after

    def _repeat(self, key: int, times: int, size: int) -> None:
        """Add occurrences of a line that have ``size`` characters together."""
        if self.lines is not None:
            t, c = self.lines.get(key, (0, 0))
            self.lines[key] = t + times, c + size

    def merge(self, other: State) -> State:
        """The state of this run followed by the other's."""
        if other.tail is None:
            if self.tail is None:
                self.head += other.head
            else:
                self.tail += other.head
            return self
        if self.tail is None:
            other.head = self.head + other.head
            return other
        self._finish(self.tail + other.head)
        self.tail = other.tail
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        for own in self.by:
            counts, after = other.by[own[1]]
            own[0] = [a + b for a, b in zip(own[0], counts, strict=True)]
            own[1] = after
        for k, (t, c) in (other.lines or {}).items():
            self._repeat(k, t, c)
        return self

    def done(self, repeated: int | None = None) -> tuple:
        """Finish head and tail and derive the ratios; ``repeated``: characters of repeated lines, where they were counted elsewhere."""
        first, last = State(""), self.tail
        first._finish(self.head)
        whole = first
        if last is not None:
            whole.tail = ""
            self.head = ""
            rest = State("")
            rest.sums, rest.by, rest.lines, rest.tail = self.sums, self.by, self.lines, last
            whole.sums = [a + b for a, b in zip(whole.sums, rest.sums, strict=True)]
            counts, after = rest.by[whole.by[NONE][1]]
            whole.by[NONE] = [[a + b for a, b in zip(whole.by[NONE][0], counts, strict=True)], after]
            for k, (t, c) in (rest.lines or {}).items():
                whole._repeat(k, t, c)
            whole._finish(last)
        n = dict(zip(SUMS, whole.sums, strict=True))
        kinds = whole.by[NONE][0]
        if repeated is None:
            repeated = sum(c for t, c in whole.lines.values() if t >= REPEATS)
        solid, words, lines = n["n_solid"], n["n_words"], n["n_lines"]
        if not solid:
            verdict = "blank"
        elif repeated > 0.5 * solid:
            verdict = "junk"
        elif 2 * (solid - kinds[PROSE]) > solid:
            verdict = KINDS[max((LIST, TABLE, JUNK), key=lambda k: kinds[k])]
        else:
            verdict = "prose"
        ratio = lambda a, b: a / b if b else None
        return (
            n["n_chars"] - 1, words, lines, ratio(n["word_chars"], words), ratio(n["n_symbols"], solid), ratio(n["n_punct_lines"], lines),
            ratio(n["n_common"], words), ratio(solid - kinds[PROSE], solid), ratio(repeated, solid), verdict,
        )


def hash_line(line: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))


RESULT = ("n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "punct_line_share", "common_word_share", "other_share", "repeated_share", "verdict")
RESULT_DDL = "n_chars bigint, n_words bigint, n_lines bigint, mean_word_length double, symbol_ratio double, punct_line_share double, common_word_share double, other_share double, repeated_share double, verdict string"


def repeated_characters(rows: DataFrame) -> DataFrame:
    """(_row, repeated): non-blank characters of the lines that occur ``REPEATS`` times or more in the text of a row; rows without any are missing."""
    lines = rows.select("_row", F.explode(F.split("text", "\n", -1)).alias("_line"))
    lines = lines.select("_row", F.regexp_replace("_line", f"^{BLANK}|{BLANK}$", "").alias("_bare")).where(F.col("_bare") != "")
    sized = lines.select("_row", F.xxhash64("_bare").alias("_key"), F.length(F.regexp_replace("_bare", BLANK, "")).alias("_size"))
    counts = sized.groupBy("_row", "_key").agg(F.count(F.lit(1)).alias("_times"), F.sum("_size").alias("_chars"))
    return counts.where(F.col("_times") >= REPEATS).groupBy("_row").agg(F.sum("_chars").alias("repeated"))


def text_quality(documents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Statistics and verdict of every row of ``documents`` (doc_id, text; other columns are ignored).

    A null text has null statistics and the verdict null, a blank one the verdict ``blank``; repeated rows
    give repeated results. The verdict is ``prose`` unless over half of the non-blank characters belong to
    lines that aren't running sentences, then ``list``, ``table`` or ``junk``; a text of which over half are
    lines that occur four times or more is ``junk``.
    """
    if chunk < 1:
        raise ValueError("chunk must be positive")
    documents = documents.select("doc_id", "text")
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = documents.where(~long)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *(State(t).done() if t is not None else [None] * len(RESULT))) for i, t in zip(b.doc_id, b.text, strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", *RESULT]).astype({c: "Int64" for c in ("doc_id", "n_chars", "n_words", "n_lines")})

    out = short.mapInPandas(whole, f"doc_id bigint, {RESULT_DDL}")
    rows = spill_table(documents.where(long).withColumn("_row", F.monotonically_increasing_id()), "long_texts")
    most = rows.agg(F.max(F.length("text")).alias("n")).first()["n"]
    if most is None:
        return out
    cuts = rows.withColumn("_cut", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / F.lit(chunk)).cast("int") - 1)))
    cuts = cuts.select("doc_id", "_row", F.col("_cut").cast("bigint").alias("_no"), F.substring("text", F.col("_cut") * chunk + 1, F.lit(chunk)).alias("text"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(state=[pickle.dumps(State(t, counted=False)) for t in b.text])[["doc_id", "_row", "_no", "state"]]

    states = cuts.mapInPandas(partial, "doc_id bigint, _row bigint, _no bigint, state binary")
    left = -(-most // chunk)

    def merged(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("_no")
        state = None
        for x in batch.state:
            own = pickle.loads(x)
            state = own if state is None else state.merge(own)
        return batch.iloc[:1].assign(_no=batch["_no"] // FAN_IN, state=[pickle.dumps(state)])

    while left > 1:
        states = states.groupBy("_row", F.floor(F.col("_no") / FAN_IN).alias("_group")).applyInPandas(merged, "doc_id bigint, _row bigint, _no bigint, state binary")
        left = -(-left // FAN_IN)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *pickle.loads(s).done(int(n))) for i, s, n in zip(b.doc_id, b.state, b.repeated, strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", *RESULT]).astype({"doc_id": "Int64"})

    states = states.join(repeated_characters(rows), "_row", "left").select("doc_id", "state", F.coalesce("repeated", F.lit(0)).alias("repeated"))
    return out.unionByName(states.mapInPandas(finish, f"doc_id bigint, {RESULT_DDL}"))


def p9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return text_quality(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't natural prose."""
    return p9_quality(spark, sf_dir).where(F.col("verdict").isin("list", "table", "junk")).select("doc_id").distinct()


QUERIES = {"p9_found": p9_found, "p9_quality": p9_quality}
SQL: dict[str, str] = {}
