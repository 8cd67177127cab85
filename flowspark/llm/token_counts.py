"""Token counts that follow edits, by pre-token segment trees (operator 10)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import kept, table

LEAF = 64  # pre-tokens to a leaf
# A pre-token's end depends on so many characters after it at most: a contraction's two
# letters, or the character behind a blank.
CONTEXT = 4
_KNOWN = 800_000


def ranks_path(name="byte_bpe_50k.tiktoken"):
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Pre-tokens of a text and their numbers of tokens, each distinct one encoded once."""

    def __init__(self, path=None):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path or ranks_path(), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.encoding = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, piece):
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= _KNOWN:
                self.known.clear()
            found = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return found

    def leaves(self, text):
        """(characters, tokens) of each LEAF pre-tokens."""
        pieces = self.pattern.findall(text)
        count = self.count
        return [
            (sum(map(len, part)), sum(map(count, part)))
            for part in (pieces[i:i + LEAF] for i in range(0, len(pieces), LEAF))
        ]


class Tree:
    """Sums of characters and tokens over a text's leaves, in a heap: node i has the
    children 2i and 2i+1, the leaves are the last `size` nodes, empty ones included."""

    def __init__(self, leaves):
        self._build(leaves)

    def _build(self, leaves):
        leaves = leaves or [(0, 0)]
        self.n, self.size = len(leaves), 1 << max(0, len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (c, t) in enumerate(leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = c, t
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i):
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaves(self):
        return list(zip(self.chars[self.size:self.size + self.n], self.tokens[self.size:self.size + self.n]))

    def find(self, char):
        """The leaf that holds a character, and where the leaf starts. The end of the text
        is in the last leaf."""
        if char >= self.chars[1]:
            last = self.n - 1
            return last, self.chars[1] - self.chars[self.size + last]
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if char - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def replace(self, low, high, parts):
        """Leaves low to high-1 become `parts`. As many or fewer: their sums and those above
        change. More: the tree is laid out anew, from the sums."""
        if len(parts) > high - low:
            own = self.leaves()
            self._build(own[:low] + parts + own[high:])
            return
        parts = parts + [(0, 0)] * (high - low - len(parts))
        for i, (c, t) in enumerate(parts, self.size + low):
            self.chars[i], self.tokens[i] = c, t
        low, high = self.size + low, self.size + high - 1
        while low > 1:
            low, high = low // 2, high // 2
            for i in range(low, high + 1):
                self._sum(i)


def edit(counter, tree, text, edits):
    """The edited text and the number of pre-tokens counted again. `edits`: (start, stop,
    replacement) in characters of the text as it was, put in order and clipped so that
    none begins before the one before it ends. The tree follows."""
    clean, at = [], 0
    for start, stop, new in sorted((max(0, s or 0), max(0, e or 0), r or "") for s, e, r in edits):
        start = min(max(start, at), len(text))
        at = min(max(stop, start), len(text))
        clean.append((start, at, new))
    again = 0
    for start, stop, new in reversed(clean):
        # Pre-tokens that end CONTEXT characters before the edit stay; from a border on, the
        # pattern sees what follows only.
        low, begin = tree.find(max(0, start - CONTEXT))
        high, border = tree.find(stop)
        text = text[:start] + new + text[stop:]
        shift = len(new) - (stop - start)
        sizes, n = tree.chars, tree.size
        border += sizes[n + high]
        high += 1
        pieces, end = [], begin
        for match in counter.pattern.finditer(text, begin):
            piece, end = match.group(), match.end()
            pieces.append((len(piece), counter.count(piece)))
            while high < tree.n and border + shift < end:
                border += sizes[n + high]
                high += 1
            if border + shift == end:
                break
        else:
            high = tree.n  # the text ends before a border is met
        again += len(pieces)
        leaves = [
            (sum(c for c, _ in part), sum(t for _, t in part))
            for part in (pieces[i:i + LEAF] for i in range(0, len(pieces), LEAF))
        ]
        tree.replace(low, max(high, low), leaves)
    return text, again


_made: dict = {}


def _counter(path):
    if path not in _made:
        _made[path] = Counter(path)
    return _made[path]


TREES = "doc_id {id}, text_hash long, n_pretokens long, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>"


def _texts(docs, id_column, text_column):
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def build(docs: DataFrame, path=None, id_column="doc_id", text_column="text") -> DataFrame:
    """Written trees of whole texts: a row per row of `docs` with the leaves' sums (the sums
    above follow from them) and a hash of the text, which itself stays where it is. Null
    texts count as empty; a null id is a document too."""
    docs = _texts(docs, id_column, text_column)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batches):
        import pyarrow as pa

        counter = _counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                leaves, pieces = [], []
                for text in rows.column("text").to_pylist():
                    found = counter.pattern.findall(text or "")
                    pieces.append(len(found))
                    count = counter.count
                    leaves.append([
                        (sum(map(len, part)), sum(map(count, part)))
                        for part in (found[i:i + LEAF] for i in range(0, len(found), LEAF))])
                column = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("text_hash"), pa.array(pieces, pa.int64()),
                     pa.array([sum(t for _, t in x) for x in leaves], pa.int64()),
                     pa.array([[c for c, _ in x] for x in leaves], column),
                     pa.array([[t for _, t in x] for x in leaves], column)],
                    ["doc_id", "text_hash", "n_pretokens", "n_tokens", "leaf_chars", "leaf_tokens"])

    return kept(docs.mapInArrow(make, TREES.format(id=kind)))


def apply_edits(
    trees: DataFrame, docs: DataFrame, edits: DataFrame, path=None, id_column="doc_id", text_column="text"
) -> DataFrame:
    """Counts after edits (doc_id, start, stop, replacement), in characters of the text.

    A row per row of `docs`, the rows that `trees` were built from (an error if one has
    none): doc_id, text (edited), n_tokens (before), n_tokens_edited,
    n_reencoded (pre-tokens counted again: those of the leaves an edit touches and of the
    leaf before when the edit begins right behind it), and the new leaves. Edits are put
    in order and clipped to the text and to each other; nulls in them count as 0 or as an
    empty replacement. Edits of a repeated id go to all its rows; those without a document
    are ignored, and so are null ids. The edits go to the trees first, as both are small
    beside the texts; these move once at most.
    """
    docs = _texts(docs, id_column, text_column)
    kind = trees.schema["doc_id"].dataType.simpleString()
    lists = edits.where("doc_id is not null").groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "stop", "replacement")).alias("edits"))

    def change(batches):
        import pyarrow as pa

        counter = _counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                texts, tokens, again, leaves = [], [], [], []
                for text, chars, counts, own in zip(*[
                        rows.column(c).to_pylist() for c in ("text", "leaf_chars", "leaf_tokens", "edits")]):
                    if chars is None:
                        raise ValueError("a document has no tree of its text")
                    tree = Tree(list(zip(chars, counts)))
                    done, n = edit(counter, tree, text or "", [tuple(e.values()) for e in own or ()])
                    texts.append(done if own or text is not None else None)
                    tokens.append(tree.tokens[1])
                    again.append(n)
                    leaves.append(tree.leaves())
                column = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(texts, pa.string()), rows.column("n_tokens"),
                     pa.array(tokens, pa.int64()), pa.array(again, pa.int64()),
                     pa.array([[c for c, _ in x] for x in leaves], column),
                     pa.array([[t for _, t in x] for x in leaves], column)],
                    ["doc_id", "text", "n_tokens", "n_tokens_edited", "n_reencoded", "leaf_chars", "leaf_tokens"])

    # Rows that repeat an id and a text have the same tree.
    edited = trees.dropDuplicates(["doc_id", "text_hash"]).join(lists, "doc_id", "left").withColumnRenamed(
        "doc_id", "id").withColumnRenamed("text_hash", "hash")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    joined = docs.join(edited, same, "left").select("doc_id", "text", "n_tokens", "leaf_chars", "leaf_tokens", "edits")
    return joined.mapInArrow(
        change, f"doc_id {kind}, text string, n_tokens long, n_tokens_edited long, n_reencoded long, "
        "leaf_chars array<int>, leaf_tokens array<int>")


def op10_token_counts(spark: SparkSession, sf_dir) -> DataFrame:
    """Three edits to every document: five characters go a quarter in, a word comes in the
    middle, and three characters are replaced at three quarters."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    n = F.length("text")

    def at(share, length, new):
        start = F.floor(n * share / 4).cast("int")
        return F.struct(start.alias("start"), (start + length).alias("stop"), F.lit(new).alias("replacement"))

    edits = docs.select("doc_id", F.explode(F.array(at(1, 5, ""), at(2, 0, " inserted"), at(3, 3, "'s 42"))).alias("e"))
    done = apply_edits(build(docs), docs, edits.select("doc_id", "e.*"))
    return done.select("doc_id", "n_tokens", "n_tokens_edited", "n_reencoded")
