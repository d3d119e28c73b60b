"""Variant spellings of names typed by people.

Method: a trie join. Names are reduced to a core (titles, legal forms and common words aside) and sharded by the
first or the last half of the core, one of which any single edit leaves whole (by segments for more edits). Within
each shard the cores make up a trie, which a Levenshtein automaton walks for each of them, so that neighbours within
the distance are enumerated without comparing all pairs; cores of several words take part in the orders of their words.
Neighbours become links, links become groups, and shortened forms (initials, a word left out) join the one group that
they can stand for.

Which words are common to many companies (their trades) is learned from the names themselves: a word that follows
many different first words tells nothing about which company is meant, but must agree. Short forms of such words are
recognised by the order of their letters. Only closed classes of words are given: legal forms, titles and nicknames.

Equal names are counted once before anything else, so a hot spelling is one row. A shard of more than
``most_in_shard`` cores is walked in blocks: each block holds a part of them in its trie, and all stream past it.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.functions.text import plain_key
from claimforge.functions.worker import kept
from claimforge.llm.groups import connected_groups
from claimforge.session import Scratch

#: Legal forms, which do not tell companies of one name apart.
LEGAL = frozenset("limited ltd lmtd incorporated inc corporation corp corpn company co private pvt pte holdings holding hldgs hldg plc llc llp lp gmbh ag sa nv bv".split())
#: Given names with their short forms.
GIVEN = {
    "alexander": "alex alec sandy sasha xander", "benjamin": "ben benny benji", "christopher": "chris kit topher", "deborah": "deb debbie debra", "edward": "ed eddie ned", "elizabeth": "liz beth betty eliza lizzie", "frederick": "fred freddie freddy", "gabriella": "gabi gabby gaby", "harold": "harry hal",
    "isabella": "bella izzy isa", "jonathan": "jon jonny nathan", "katherine": "kate kathy katie kat", "margaret": "peggy maggie meg marge", "michael": "mike mick mickey", "nicholas": "nick nicky", "patricia": "pat patty trish tricia", "rebecca": "becky becca", "richard": "dick rick rich richie",
    "robert": "bob rob bobby robbie", "samantha": "sam sammy", "theodore": "ted theo teddy", "thomas": "tom tommy", "victoria": "vicky vicki tori", "william": "bill will billy willie", "james": "jim jimmy", "john": "johnny jack", "joseph": "joe joey", "charles": "charlie chuck", "david": "dave", "daniel": "dan danny",
    "anthony": "tony", "steven": "steve", "andrew": "andy", "susan": "sue susie", "jennifer": "jen jenny", "catherine": "cathy", "anne": "annie", "mary": "molly", "matthew": "matt", "timothy": "tim",
}
TITLES = frozenset("mr mrs ms miss dr prof sir shri smt".split())
_GIVEN = {s: k for k, v in GIVEN.items() for s in (k, *v.split())}
_SMALL = frozenset("the and of m s".split())
_VOWELS = frozenset("aeiou")


def _edits(word: str) -> set[str]:
    """What is left of a word without one letter, and the word: words within one edit share one of these."""
    return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}


def within_one(a: str, b: str) -> bool:
    """Whether one letter added, left out, changed or exchanged with its neighbour makes a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    x, y = a[k:], b[k:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) >= 2 and len(y) >= 2 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def _follows(short: str, word: str) -> bool:
    """Whether a word is cut short with letters left out: behind what both begin with it has consonants only, in order."""
    alike = next((k for k, (x, y) in enumerate(zip(short, word)) if x != y), min(len(short), len(word)))
    letters = iter(word[alike:])
    return alike > 0 and _VOWELS.isdisjoint(short[alike:]) and all(c in letters for c in short[alike:])


def short_for(word: str, words: list[str]) -> str | None:
    """The one of some words that a word is short for: cut off at the end, else with letters left out.

    A word with up to two letters more stands for the word as well.
    """
    alike = [w for w in words if w[0] == word[0] and w != word]
    cut = [w for w in alike if len(word) > 2 and w.startswith(word) or len(w) >= 4 and word.startswith(w) and len(word) <= len(w) + 2]
    found = cut or [w for w in alike if len(word) < len(w) and _follows(word, w)]
    return found[0] if len(found) == 1 else None


class Vocabulary:
    """Words that do not tell names apart: words of trade with their short forms, legal forms, given names with nicknames."""

    def __init__(self, trade: tuple[str, ...], shorts: tuple[tuple[str, str], ...]):
        self.trade, self.shorts = frozenset(trade), dict(shorts)
        self.words = sorted(self.trade)
        slips = {w for w in (*trade, *self.shorts, *LEGAL, *_GIVEN) if len(w) >= 5} | {w for w in trade if len(w) >= 4}
        self.near: dict[str, list[str]] = {}
        for word in sorted(slips):
            for rest in _edits(word):
                self.near.setdefault(rest, []).append(word)
        # Words that may be typed onto the one before.
        self.tails = sorted({w for w in (*trade, *LEGAL) if len(w) >= 4}, key=lambda w: (-len(w), w))
        self.made: dict[str, str] = {}

    def known(self, word: str) -> str:
        """The known word, words run together, that a word stands for; or the word itself."""
        if len(word) < 2 or word in self.trade or word in LEGAL or word in _GIVEN or word in TITLES or word in _SMALL:
            return word
        if word not in self.made:
            if len(self.made) > 200_000:
                self.made.clear()
            self.made[word] = self._known(word)
        return self.made[word]

    def _known(self, word: str) -> str:
        if word in self.shorts:
            return self.shorts[word]
        if len(word) >= 3:
            near = {w for e in _edits(word) for w in self.near.get(e, ()) if within_one(word, w)}
            if len({self.shorts.get(w) or _GIVEN.get(w, w) for w in near}) == 1:
                return self.shorts.get(min(near), min(near))
        for k in range(3, len(word) - 2):
            both = [[w for w in self.words if len(w) > len(part) and w.startswith(part)] for part in (word[:k], word[k:])]
            if all(len(found) == 1 for found in both):
                return f"{both[0][0]} {both[1][0]}"
        return word


def _legal(tokens: list[str]) -> str:
    """The legal form of a company, one word for all ways to write it; '' if it has none."""
    for words, form in ((("holdings", "holding", "hldgs", "hldg"), "holdings"), (("private", "pvt", "pte"), "private"), (("incorporated", "inc"), "incorporated"), (("corporation", "corp", "corpn"), "corporation"), (("company", "co"), "company")):
        if any(w in words for w in tokens):
            return form
    return "limited" if any(t in LEGAL for t in tokens) else ""


def parse_name(key: str, vocabulary: Vocabulary) -> tuple[str, str, list[str], list[str], str]:
    """(kind, trade, words, initials, middle) of a plain key; kind is 'c' for companies and 'p' for persons.

    For persons trade is the given name where it is known, for companies middle is the legal form.
    """
    text = re.sub(r"\bint l\b", "international", re.sub(r"\bnat l\b", "national", key))
    text = re.sub(r"\b(p|pvt) ltd\b", "private limited", text)
    common = lambda token: token in vocabulary.trade or token in LEGAL
    tokens: list[str] = []
    for token in " ".join(map(vocabulary.known, text.split())).split():
        parts: list[str] = []
        while not common(token) and token not in _GIVEN:
            tail = next((w for w in vocabulary.tails if token.endswith(w) and len(token) - len(w) >= 4), None)
            if tail is None:
                break
            token, parts = token[: -len(tail)], [tail, *parts]
        tokens += [token, *parts]
    if any(t in LEGAL or t in vocabulary.trade and len(t) > 3 for t in tokens):
        if tokens[:2] == ["m", "s"]:
            tokens = tokens[2:]
        trade = sorted({t for t in tokens if t in vocabulary.trade})
        rest = [t for t in tokens if not common(t) and (t not in _SMALL or t in ("m", "s"))]
        return "c", " ".join(trade), [t for t in rest if len(t) > 1], [t for t in rest if len(t) == 1], _legal(tokens)
    tokens = [t for t in tokens if t not in TITLES] or tokens
    long = [_GIVEN.get(t, t) for t in tokens if len(t) > 1]
    initials = [t for t in tokens if len(t) == 1]
    given = [t for t in long if t in GIVEN]
    if len(long) >= 2:
        if len(given) == 1:
            return "p", given[0], [t for t in long if t not in given], [], "".join(initials)
        return "p", "", long, [], "".join(initials)
    return "p", "", long, initials, ""


def _orders(words: list[str]) -> list[tuple[str, ...]]:
    """Orders of words that are tried: all of up to three words, of more the turned ones and the sorted one."""
    if len(words) <= 3:
        return list(itertools.permutations(words))
    return list(dict.fromkeys([*(tuple(words[k:] + words[:k]) for k in range(len(words))), tuple(sorted(words))]))


def common_words(keys: DataFrame, share: float = 0.02, least: int = 8, share_short: float = 0.0005, least_short: int = 3) -> tuple[tuple[str, ...], tuple[tuple[str, str], ...]]:
    """The words of trade of the plain keys ``key``, and their short forms (short, word).

    A word of trade follows at least ``share`` of all first words (many first words, not many names: one company in
    many spellings has but a few). A short form follows ``share_short`` of them and is short for just one such word.
    """
    tokens = keys.select(F.split("key", " ").alias("t")).select(F.element_at("t", 1).alias("first"), F.explode(F.array_distinct("t")).alias("word"))
    known = [*LEGAL, *TITLES, *_GIVEN, *_SMALL]
    spread = tokens.where((F.col("word") != F.col("first")) & (F.length("word") > 1) & ~F.col("word").isin(known) & ~F.col("first").isin([*_GIVEN, *TITLES]))
    by = spread.distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_short)
    firsts = tokens.agg(F.count_distinct("first").alias("n")).first()["n"]
    # A name of some ten words has as many beside its first, so ten in a share of first words bound what is collected.
    most = int(10 / share_short)
    found = by.where(F.col("n") >= share_short * firsts).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError("more common words than their share allows")
    trade = tuple(sorted(r.word for r in found if r.n >= max(least, share * firsts) and len(r.word) > 2))
    # What is short for another word of trade is none by itself.
    shorts = {r.word: word for r in found if (word := short_for(r.word, [w for w in trade if len(w) > len(r.word) or r.word not in trade]))}
    return tuple(w for w in trade if w not in shorts), tuple(sorted(shorts.items()))


_CORES = "key string, kind string, space string, cores array<string>, middle string, shapes array<string>, short string, rests array<string>"


def _cores(batches: Iterator[pa.RecordBatch], common: tuple) -> Iterator[pa.RecordBatch]:
    """Cores of whole names, the shapes that short forms of it take, and for short forms the shape they have."""
    vocabulary = kept(("names", common), lambda: Vocabulary(*common))
    for batch in batches:
        out = []
        for key in batch.column(0).to_pylist():
            kind, trade, words, initials, middle = parse_name(key, vocabulary)
            cores, shapes, short, rests, space = [], [], None, [], f"{kind}|{trade}"
            if kind == "c":
                orders = _orders(words)
                if initials and words:
                    short = f"c|{trade}|{' '.join(sorted(words))}|{''.join(sorted(initials))}|{middle}"
                elif words:
                    cores = sorted({"".join(o) for o in orders})
                    short = f"c|{trade}|{' '.join(sorted(words))}||{middle}"
                    for k, word in enumerate(words) if len(words) > 1 else ():
                        rest = " ".join(sorted(words[:k] + words[k + 1 :]))
                        shapes += [f"c|{trade}|{rest}|{word[0]}", f"c|{trade}|{rest}|"]
                        rests += ["".join(o) for o in _orders(words[:k] + words[k + 1 :])]
                    parts = trade.split()
                    shapes += [f"c|{' '.join(parts[:k] + parts[k + 1 :])}|{' '.join(sorted(words))}|" for k in range(len(parts)) if len(parts) > 1]
                    shapes = [f"{shape}|{form}" for shape in shapes for form in {"", middle}]
                else:
                    cores = [trade or key]
            elif len(words) >= 2 or trade:
                orders = _orders(words)
                if trade:  # a given name is known
                    cores = sorted({f"{trade} {''.join(o)}" for o in orders})
                    firsts = [(trade, "".join(o)) for o in orders]
                else:
                    cores = sorted({" ".join(o) for o in orders})
                    firsts = [(o[0], "".join(o[1:])) for o in orders]
                space = "p"
                shapes = [f"p|{last}|{first[0]}|{m}" for first, last in firsts for m in {"", middle[:1]}]
            elif words and initials:
                short, space = f"p|{words[0]}|{initials[0]}|{''.join(initials[1:2])}", "p"
            else:
                cores = [key]
            out.append((key, kind, space, cores, middle, sorted(set(shapes)), short, sorted(set(rests))))
        columns = list(zip(*out)) or [[]] * 8
        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in _CORES.split(", ")])


def _halves(core: Column) -> Column:
    """Shard keys: one edit leaves the first or the last half of the shorter of two cores whole.

    Halves leave out the middle, where letters may be exchanged; cores of up to three letters all meet.
    """
    n = F.length(core)
    sizes = F.array_distinct(F.array(F.greatest(F.floor((n - 1) / 2), F.lit(0)), F.greatest(F.floor((n - 2) / 2), F.lit(0))))
    first = F.transform(sizes, lambda k: F.concat(F.lit("<"), F.substring(core, F.lit(1), k.cast("int"))))
    last = F.transform(sizes, lambda k: F.concat(F.lit(">"), F.substring(core, (n - k + 1).cast("int"), k.cast("int"))))
    return F.concat(first, last)


def _segments(core: Column, limit: int) -> tuple[Column, Column]:
    """Shard keys of cores as held and as asked for ``limit`` edits, an exchange of letters being one.

    A held core is cut into 2 * limit + 1 segments, of which limit edits leave one whole, moved by limit places at most; a
    core asks for each such piece of it, for each length that the other may have.
    """
    n, pieces = F.length(core), 2 * limit + 1
    start = lambda size, k: F.floor(size * k / pieces)
    key = lambda size, k, at: F.concat_ws(":", size.cast("string"), k.cast("string"), F.substring(core, (at + 1).cast("int"), (start(size, k + 1) - start(size, k)).cast("int")))
    numbers = F.sequence(F.lit(0), F.lit(pieces - 1))
    held = F.transform(numbers, lambda k: key(n, k, start(n, k)))
    lengths = F.sequence(F.greatest(n - limit, F.lit(0)), n + limit)
    moves = F.sequence(F.lit(-limit), F.lit(limit))
    asked = F.flatten(F.transform(lengths, lambda size: F.flatten(F.transform(numbers, lambda k: F.transform(F.filter(moves, lambda m: start(size, k) + m >= 0), lambda m: key(size, k, start(size, k) + m))))))
    return held, F.array_distinct(asked)


_END = "\0"


def _insert(trie: dict, word: str) -> None:
    for c in word:
        trie = trie.setdefault(c, {})
    trie[_END] = word


def _walk(trie: dict, word: str, limit: int) -> Iterator[str]:
    """Words of the trie that the Levenshtein automaton of ``word`` accepts: rows of distances are its states."""
    n = len(word)
    stack = [(trie, list(range(n + 1)), None, "")]
    while stack:
        node, row, above, before = stack.pop()
        for c, child in node.items():
            if c == _END:
                if row[n] <= limit:
                    yield child
                continue
            new = [row[0] + 1]
            for j in range(1, n + 1):
                cost = min(row[j] + 1, new[-1] + 1, row[j - 1] + (word[j - 1] != c))
                if above and j > 1 and c == word[j - 2] and before == word[j - 1]:
                    cost = min(cost, above[j - 2] + 1)
                new.append(cost)
            if min(new) <= limit:
                stack.append((child, new, row, c))


def trie_join(cores: DataFrame, limit: int = 1, most_in_shard: int = 20_000) -> DataFrame:
    """(a, b, space), a < b: all different ``core`` values of one ``space`` within ``limit`` edits (letters exchanged count as one).

    One edit shards by halves, more by segments. Rows without space or core are left out.
    """
    cores = cores.select("space", "core").where("space is not null and core is not null").distinct()
    if limit == 1:
        placed = cores.select("space", "core", F.explode(_halves(F.col("core"))).alias("key"), F.lit(True).alias("holds"))
    else:
        held, asked = _segments(F.col("core"), limit)
        placed = cores.select("space", "core", F.explode(held).alias("key"), F.lit(True).alias("holds")).unionByName(cores.select("space", "core", F.explode(asked).alias("key"), F.lit(False).alias("holds")))
    placed = placed.withColumn("shard", F.concat_ws("\u0001", "space", "key")).drop("key")
    large = placed.where("holds").groupBy("shard").count().where(F.col("count") > most_in_shard).select("shard", F.ceil(F.col("count") / most_in_shard).cast("int").alias("blocks"))
    placed = placed.join(large, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("held", F.col("holds") & (F.pmod(F.xxhash64("core"), F.col("blocks")) == F.col("block")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, trie = None, {}
        for batch in batches:
            out: set[tuple] = set()
            for name, block, core, held in zip(*(c.to_pylist() for c in batch.columns)):
                if (name, block) != shard:
                    shard, trie = (name, block), {}
                # What a block holds comes first, and each asks those before it; the others ask all, and stay nowhere.
                out.update((min(core, found), max(core, found), name.partition("\u0001")[0]) for found in _walk(trie, core, limit) if found != core)
                if held:
                    _insert(trie, core)
            columns = list(zip(*out)) or [[]] * 3
            yield pa.record_batch([pa.array(c, pa.string()) for c in columns], names=["a", "b", "space"])

    spaced = placed.select("shard", "block", "core", "held").repartition("shard", "block").sortWithinPartitions("shard", "block", F.desc("held"))
    return spaced.mapInArrow(walk, "a string, b string, space string").distinct()


def link_names(records: DataFrame, name: str, trade_words: list[str] | None = None, trade_shorts: dict[str, str] | None = None) -> DataFrame:
    """(name, entity): each plain key of the names with the entity it belongs to (the smallest key of the entity).

    Null and blank names give no row, and names without letters or digits none either. Names of one entity are those
    whose cores lie within one edit of each other, directly or through others: legal forms, titles, word order,
    abbreviations and nicknames do not matter; trade words and, where both have one, middle initials must agree.
    Initials and names with a word left out join an entity only if there is exactly one that they can stand for.
    ``trade_words`` and their short forms are given for names too few to learn them from.
    """
    scratch = Scratch(records.sparkSession, "names")
    keys = records.select(plain_key(F.col(name)).alias("key")).where("key <> ''").distinct()
    keys = scratch.write(keys, "keys")
    common = common_words(keys) if trade_words is None else (tuple(sorted(trade_words)), tuple(sorted((trade_shorts or {}).items())))
    parsed = scratch.write(keys.mapInArrow(lambda batches: _cores(batches, common), _CORES), "parsed")
    whole = parsed.where("size(cores) > 0")
    cores = whole.select("space", F.explode("cores").alias("core"))
    node = lambda space, core: F.concat_ws("\u0002", space, core)
    # A name that is what another leaves when a word is left out is that one's short form, no slip of a third name.
    rests = parsed.select("space", F.explode("rests").alias("core")).distinct()
    near = trie_join(cores)
    for end in ("a", "b"):
        near = near.join(rests.select("space", F.col("core").alias(end), F.lit(True).alias(f"rest_{end}")), ["space", end], "left")
    near = near.where(F.coalesce("rest_a", F.lit(False)) == F.coalesce("rest_b", F.lit(False)))
    near = near.select(node(F.col("space"), F.col("a")).alias("a"), node(F.col("space"), F.col("b")).alias("b"))
    orders = whole.where("size(cores) > 1").select(node(F.col("space"), F.col("cores")[0]).alias("a"), F.explode(F.slice(F.col("cores"), F.lit(2), F.size("cores"))).alias("core"), "space").select("a", node(F.col("space"), F.col("core")).alias("b"))
    groups = connected_groups(near.unionByName(orders), "a", "b").select(F.col("member").alias("node"), "group_id")
    own = whole.withColumn("node", node(F.col("space"), F.col("cores")[0])).join(groups, "node", "left").select("key", "kind", "middle", "shapes", "short", F.coalesce("group_id", "node").alias("family"))
    own = scratch.write(own, "families")
    # Persons of one name stay apart if their middle initials do; a name without one joins the only one there is.
    middles = own.where("kind = 'p' and middle <> ''").groupBy("family").agg(F.min(F.substring("middle", 1, 1)).alias("one"), F.max(F.substring("middle", 1, 1)).alias("other"))
    split = F.col("one") != F.col("other")
    own = own.join(middles, "family", "left").withColumn("entity", F.when(F.coalesce(split, F.lit(False)), F.concat_ws("\u0003", "family", F.substring("middle", 1, 1))).otherwise(F.col("family")))
    own = scratch.write(own.select("key", "kind", "entity", "shapes", "short"), "entities")
    shapes = own.select(F.explode("shapes").alias("short"), "entity").groupBy("short").agg(F.min("entity").alias("entity"), F.max("entity").alias("other")).where("entity = other").select("short", F.col("entity").alias("stands_for"))
    shorts = parsed.where("size(cores) = 0 and short is not null").select("key", "short", F.concat(F.lit("\u0004"), "short").alias("entity")).unionByName(own.where("kind = 'c' and short is not null").select("key", "short", "entity"))
    joined = shorts.join(shapes, "short").where("entity <> stands_for").select(F.col("entity").alias("a"), F.col("stands_for").alias("b"))
    merged = connected_groups(joined, "a", "b").select(F.col("member").alias("entity"), F.col("group_id").alias("into"))
    every = own.select("key", "entity").unionByName(shorts.join(own.select("key"), "key", "left_anti").select("key", "entity")).unionByName(parsed.where("size(cores) = 0 and short is null").select("key", F.col("key").alias("entity")))
    every = scratch.write(every.join(merged, "entity", "left").select("key", F.coalesce("into", "entity").alias("entity")), "names")
    least = every.groupBy("entity").agg(F.min("key").alias("least"))
    return every.join(least, "entity").select(F.col("key").alias("name"), F.col("least").alias("entity"))


def name_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: all pairs of names within an entity of ``link_names``."""
    a, b = linked.select(F.col("name").alias("name_a"), "entity"), linked.select(F.col("name").alias("name_b"), "entity")
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
