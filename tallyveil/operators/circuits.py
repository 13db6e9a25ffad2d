"""Encrypted counting: Boolean circuits in the clear, homomorphic sums, blinded comparison, and disguised transactions."""

from __future__ import annotations

import hashlib
import hmac
import itertools
import math
import secrets
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.itemsets import Item, Itemset

# Boolean circuits


#: Words of a bit-sliced counter: each of its bits is a lane that counts rows of its own.
LANES = 64


def _sliced_add(counter: list[np.ndarray], bit: np.ndarray) -> None:
    """A bit more for every lane of a counter whose k-th slice holds the k-th digits: half adders from the lowest digit on."""
    for k, digit in enumerate(counter):
        counter[k], bit = digit ^ bit, digit & bit
        if not bit.any():
            return
    counter.append(bit)


def circuit_supports(wide: DataFrame, items: Sequence[Item], itemsets: Sequence[Itemset], block: int = 1 << 16) -> DataFrame:
    """candidate, support, and how many gates the circuit takes: and, or, not, xor.

    For each row and candidate the circuit tests q -> t over all public items (a NOT, an OR and an AND
    each) and adds the bit to a counter, lowest digit first (an XOR and an AND a digit). The gates are evaluated in
    the tasks, on blocks of at most `block` rows packed to bitmaps, 64 rows a word; a task hands on what its counters read.
    The numbers of gates are those of one circuit a row, with digits for all rows.
    """
    from .bitmaps import blocks

    asked = [[i in set(s) for i in items] for s in itemsets]
    if any(set(s) - set(items) for s in itemsets):
        raise ValueError("an itemset has an item that isn't public")

    def run(batches):
        import pyarrow as pa

        counters: list[list[np.ndarray]] = [[] for _ in asked]
        rows = 0
        for batch in batches:
            for k in range(batch.num_rows):
                n, packed = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                rows += n
                has = np.frombuffer(packed, np.uint64).reshape(len(items), -1)
                there = np.zeros(-(-has.shape[1] // LANES) * LANES, np.uint64)  # a bit for each row that is there, and none for the padding
                there.view(np.uint8)[: -(-n // 8)] = np.packbits(np.ones(n, np.uint8))
                for counter, q in zip(counters, asked, strict=True):
                    holds = there.copy()
                    for wanted, t in zip(q, has, strict=True):
                        not_asked = np.uint64(0) if wanted else ~np.uint64(0)
                        holds[: len(t)] &= not_asked | t
                    for chunk in holds.reshape(-1, LANES):
                        _sliced_add(counter, chunk)
        sums = [sum(int(np.bitwise_count(digit).sum()) << k for k, digit in enumerate(c)) for c in counters]
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(sums)), -1], pa.int32()), pa.array([*sums, rows], pa.int64())], ["candidate", "support"])

    packed = blocks(wide, items, block)
    counted = packed.select("n", "bits").mapInArrow(run, "candidate int, support bigint").groupBy("candidate").agg(F.sum("support").alias("support"))
    rows = counted.where("candidate = -1").select(F.col("support").alias("rows"))
    out = counted.where("candidate >= 0").crossJoin(F.broadcast(rows))  # one row
    digits = F.ceil(F.log2(F.col("rows").cast("double") + 1)).cast("bigint")
    tests = F.col("rows") * len(items)
    return out.select(
        "candidate", "support", (tests + F.col("rows") * digits).alias("and_gates"), tests.alias("or_gates"), tests.alias("not_gates"), (F.col("rows") * digits).alias("xor_gates")
    )


def packed_operations(rows: int, itemset: Itemset, owner: Mapping[int, int], items: Mapping[int, int]) -> tuple[int, int, int, int]:
    """NOT, OR, AND and XOR gates for one candidate where only the owners of its items test, each over all its public items, and their bits are joined."""
    involved = {owner[a] for a, _ in itemset}
    width, tests = max(1, math.ceil(math.log2(rows + 1))), sum(items[c] for c in involved)
    return rows * tests, rows * tests, rows * (tests + len(involved) - 1 + width), rows * width


def subset_circuit(query: Sequence[int], row: Sequence[int]) -> int:
    """1 where every asked bit is set: AND over all places of (NOT q) OR t."""
    if len(query) != len(row):
        raise ValueError("vectors of different lengths")
    out = 1
    for q, t in zip(query, row, strict=True):
        out &= (1 ^ q) | t
    return out


def add_circuit(counter: Sequence[int], bit: int) -> list[int]:
    """A counter (highest digit first) plus a bit, by half adders."""
    out = list(counter)
    for k in reversed(range(len(out))):
        out[k], bit = out[k] ^ bit, out[k] & bit
    return out


def less_circuit(a: Sequence[int], b: Sequence[int]) -> int:
    """1 where a < b, both highest digit first: the first place at which they differ decides."""
    if len(a) != len(b) or not a:
        raise ValueError("vectors of one length are needed")
    less, same = 0, 1
    for x, y in zip(a, b, strict=True):
        less ^= same & (1 ^ x) & y
        same &= 1 ^ (x ^ y)
    return less


# Additively homomorphic encryption


@lru_cache(1)
def _small_primes(below: int = 2000) -> int:
    """The product of all odd primes below a bound."""
    flags = bytearray([1]) * below
    for n in range(2, math.isqrt(below) + 1):
        if flags[n]:
            flags[n * n :: n] = bytes(len(range(n * n, below, n)))
    return math.prod(n for n in range(3, below) if flags[n])


def _witness(base: int, n: int) -> bool:
    """Whether base shows that the odd n is composite: no root of 1 on its way to base ** (n - 1) may be other than 1 and -1."""
    twos = (n - 1 & 1 - n).bit_length() - 1
    power = pow(base, n - 1 >> twos, n)
    for _ in range(twos):
        square = power * power % n
        if square == 1:
            return power not in (1, n - 1)
        power = square
    return True


def _prime(bits: int, rounds: int = 40) -> int:
    """A random prime of exactly so many bits, 3 modulo 4; a composite passes a round with chance 1/4 at most."""
    while True:
        n = (1 << bits - 1) + secrets.randbelow(1 << bits - 1) | 3
        if math.gcd(n, _small_primes()) == 1 and not any(_witness(2 + secrets.randbelow(n - 3), n) for _ in range(rounds)):
            return n


@dataclass(frozen=True)
class PublicKey:
    n: int

    def encrypt(self, message: int) -> int:
        """(1 + n) ** message * r ** n modulo n squared, for a random r prime to n."""
        if not 0 <= message < self.n:
            raise ValueError("the message isn't in the range of plain texts")
        while math.gcd(r := secrets.randbelow(self.n - 1) + 1, self.n) != 1:
            pass
        square = self.n * self.n
        return (1 + message * self.n) * pow(r, self.n, square) % square

    def encrypt_all(self, messages: Sequence[int]) -> list[int]:
        """As encrypt, for many messages: what hides each is a random power from _powers, in a few products."""
        if not all(0 <= m < self.n for m in messages):
            raise ValueError("a message isn't in the range of plain texts")
        tables, n, square = _powers(self.n), self.n, self.n * self.n
        places = np.frombuffer(secrets.token_bytes(2 * len(tables) * len(messages)), np.uint16).reshape(len(tables), -1) & len(tables[0]) - 1
        out = [1 + m * n for m in messages]
        for table, each in zip(tables, places.tolist(), strict=True):
            out = [c * table[k] % square for c, k in zip(out, each, strict=True)]
        return out

    def add(self, a: int, b: int) -> int:
        return a * b % (self.n * self.n)

    def add_plain(self, a: int, message: int) -> int:
        return a * (1 + message % self.n * self.n) % (self.n * self.n)

    def times(self, a: int, factor: int) -> int:
        return pow(a, factor, self.n * self.n)


#: Bytes that the tables of _powers may take.
POWERS_BYTES = 16_000_000


@lru_cache(2)
def _powers(n: int) -> list[list[int]]:
    """Tables of which one entry each, multiplied, is h ** (n x) modulo n squared for a random x of half as many bits as n.

    h is minus a random square (Damgard, Jurik and Nielsen): for primes that are 3 modulo 4 such powers
    hide a message as r ** n does. A table has the powers of one digit of x; each process has an h of its own.
    """
    square, bits = n * n, n.bit_length() // 2
    width = next(w for w in range(13, 0, -1) if w == 1 or -(-bits // w) * (square.bit_length() // 8 + 40 << w) <= POWERS_BYTES)
    while math.gcd(root := secrets.randbelow(n - 1) + 1, n) != 1:
        pass
    step, out = pow(-root * root % n, n, square), []
    for _ in range(-(-bits // width)):
        powers = [1]
        for _ in range((1 << width) - 1):
            powers.append(powers[-1] * step % square)
        step = powers[-1] * step % square
        out.append(powers)
    return out


def _inverses(numbers: Sequence[int], modulus: int) -> list[int]:
    """All inverses for one, and three products each."""
    before = [1]
    for x in numbers:
        before.append(before[-1] * x % modulus)
    rest, out = pow(before[-1], -1, modulus), [0] * len(numbers)
    for k in reversed(range(len(numbers))):
        out[k] = rest * before[k] % modulus
        rest = rest * numbers[k] % modulus
    return out


@dataclass(frozen=True)
class PrivateKey:
    public: PublicKey
    p: int
    q: int

    @cached_property
    def _units(self) -> tuple[tuple[int, int], tuple[int, int], int]:
        """What decrypt needs besides the cipher: each prime with the inverse of its unit, and q's inverse modulo p."""
        unit = lambda prime: (pow(1 + self.public.n, prime - 1, prime * prime) - 1) // prime
        return (self.p, pow(unit(self.p), -1, self.p)), (self.q, pow(unit(self.q), -1, self.q)), pow(self.q, -1, self.p)

    def decrypt(self, cipher: int) -> int:
        """Modulo each prime's square, then joined by the Chinese remainder theorem."""
        *halves, back = self._units
        a, b = ((pow(cipher % (prime * prime), prime - 1, prime * prime) - 1) // prime * unit % prime for prime, unit in halves)
        return (b + (a - b) * back % self.p * self.q) % self.public.n


def key_pair(bits: int = 2048) -> tuple[PublicKey, PrivateKey]:
    if bits < 256 or bits % 2:
        raise ValueError("an even number of at least 256 bits is needed")
    p = _prime(bits // 2)
    while (q := _prime(bits // 2)) == p:
        pass
    public = PublicKey(p * q)
    return public, PrivateKey(public, p, q)


class Comparison:
    """Encrypted comparison of bounded numbers; who decrypts sees random signs only."""

    def __init__(self, public: PublicKey, private: PrivateKey, bound: int, mask_bits: int = 128):
        if bound < 1 or mask_bits < 32 or (2 * bound + 2) << mask_bits >= public.n // 2:
            raise ValueError("numbers or masks are too large for the key")
        self.public, self._private, self.mask_bits, self.calls = public, private, mask_bits, 0

    def greater_all(self, xs: Sequence[int], ys: Sequence[int]) -> list[int]:
        """An encrypted 1 for each x > y, of encrypted x and of y that the cloud knows in the clear."""
        return self._positive([self.public.add_plain(self.public.times(x, 2), -2 * y - 1) for x, y in zip(xs, ys, strict=True)])

    def over(self, xs: Sequence[int], threshold: int) -> list[int]:
        """An encrypted 1 for each encrypted x over a threshold that is encrypted too."""
        less = self.public.add_plain(self.public.times(threshold, -2), -1)
        return self._positive([self.public.add(self.public.times(x, 2), less) for x in xs])

    def _positive(self, odd: Sequence[int]) -> list[int]:
        """An encrypted 1 for each positive number 2 (x - y) - 1, which is never 0.

        The cloud turns the sign by a coin of its own, stretches the number by a random factor and adds less than that, so
        that nothing but a random sign is left; where it turned the sign, it turns the answer back. All are done
        together, as inverses and powers cost far less in bulk.
        """
        key, square, top = self.public, self.public.n**2, 1 << (self.mask_bits - 1)
        turned = [bool(secrets.randbits(1)) for _ in odd]
        turn = lambda ciphers: [i if t else c for c, i, t in zip(ciphers, _inverses(ciphers, square), turned, strict=True)]
        factors = [top | secrets.randbits(self.mask_bits - 1) for _ in odd]
        offsets = key.encrypt_all([secrets.randbelow(f) for f in factors])
        answers = self.signs([pow(c, f, square) * o % square for c, f, o in zip(turn(odd), factors, offsets, strict=True)])
        return [key.add_plain(a, 1) if t else a for a, t in zip(turn(answers), turned, strict=True)]

    def signs(self, questions: Sequence[int]) -> list[int]:
        """The key holder's answers: an encrypted 1 for each positive question."""
        self.calls += len(questions)
        return self.public.encrypt_all([int(self._private.decrypt(q) <= self.public.n // 2) for q in questions])


def homomorphic_sums(rows: DataFrame, groups: list[str], flag: str, public: PublicKey) -> DataFrame:
    """groups and cipher (decimal digits): the sum of each group's flags, which are encrypted in the tasks that hold them."""
    n = public.n

    def encrypt(batches):
        for pdf in batches:
            yield pdf[groups].assign(cipher=list(map(str, PublicKey(n).encrypt_all([int(x) for x in pdf[flag]]))))

    kinds = ", ".join(f"{g} {rows.schema[g].dataType.simpleString()}" for g in groups)
    return cipher_sums(rows.select(*groups, flag).mapInPandas(encrypt, f"{kinds}, cipher string"), groups, public)


def _multiplied(held: dict, keys: Iterable, ciphers: Iterable[int], square: int) -> None:
    """Multiplies each cipher into what is held of its key."""
    for key, c in zip(keys, ciphers, strict=True):
        held[key] = held[key] * c % square if key in held else c


def cipher_sums(rows: DataFrame, groups: list[str], public: PublicKey) -> DataFrame:
    """groups and the product of their ciphers, which encrypts the sum.

    Products are of a fixed size: a task passes on one number for each group it met, and what the tasks
    pass on is multiplied together.
    """
    square = public.n * public.n

    def within(batches):
        import pandas as pd

        held: dict[tuple, int] = {}
        for pdf in batches:
            _multiplied(held, zip(*(pdf[g] for g in groups), strict=True), map(int, pdf["cipher"]), square)
        yield pd.DataFrame([(*k, str(v)) for k, v in held.items()], columns=[*groups, "cipher"])

    kinds = ", ".join(f"{g} {rows.schema[g].dataType.simpleString()}" for g in groups)
    return _total_ciphers(rows.mapInPandas(within, f"{kinds}, cipher string"), groups, public)


def _total_ciphers(rows: DataFrame, groups: list[str], public: PublicKey) -> DataFrame:
    """The product of each group's ciphers, of which every task has handed on one already."""
    square = public.n * public.n

    def across(pdf):
        product = 1
        for c in pdf["cipher"]:
            product = product * int(c) % square
        return pdf.iloc[:1].assign(cipher=str(product))

    kinds = ", ".join(f"{g} {rows.schema[g].dataType.simpleString()}" for g in groups)
    return rows.groupBy(*groups).applyInPandas(across, f"{kinds}, cipher string")


# Disguised transactions


def hashed_tid(secret: bytes, tid: str) -> bytes:
    return hmac.digest(secret, tid.encode(), "sha256")


def hashed_column(secret: bytes, tid: Column) -> Column:
    """hashed_tid by functions of the engine: the hash of the padded key and of the hash of the padded key and tid."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in key)) for pad in (0x36, 0x5C))
    sha = lambda *c: F.unhex(F.sha2(F.concat(*c), 256))
    return sha(outer, sha(inner, tid.cast("binary")))


@dataclass(frozen=True)
class Border:
    """An owner's check: items of its own, found together in no row, while any all but one of them share more rows than the threshold."""

    items: tuple[str, ...]
    threshold: int

    @classmethod
    def of(cls, owner: int, threshold: int, width: int = 3) -> Border:
        if width not in (2, 3, 4) or threshold < 0:
            raise ValueError("borders have 2 to 4 items and a threshold that isn't negative")
        return cls(tuple(f"check:{owner}:{k}:{secrets.token_hex(16)}" for k in range(width)), threshold)

    @property
    def rows(self) -> list[tuple[str, ...]]:
        """The distinct rows, each of which is sent threshold + 1 times."""
        return list(itertools.combinations(self.items, len(self.items) - 1))

    @property
    def frequent(self) -> set[frozenset]:
        return set(map(frozenset, self.rows))

    @property
    def infrequent(self) -> set[frozenset]:
        return {frozenset(self.items)}

    def item_counts(self) -> dict[str, int]:
        """An item is in every row but the one that leaves it out."""
        return dict.fromkeys(self.items, (len(self.items) - 1) * (self.threshold + 1))


def check_answer(frequent: set[frozenset], infrequent: set[frozenset], returned: set[frozenset]) -> dict[str, int | bool]:
    """What an answer lacks of the frequent sets and all that they contain, and which infrequent sets it has."""
    below = {frozenset(s) for f in frequent for size in range(len(f)) for s in itertools.combinations(sorted(f), size + 1)}
    lacks, has = len(below - returned), len(infrequent & returned)
    return {"passed": lacks + has == 0, "required": len(below), "missing": lacks, "inserted": has}


def padding_table(frequencies: DataFrame, anonymity: int) -> DataFrame:
    """item, frequency, class, deficit: items in the order of frequency form classes of `anonymity` (the last takes a smaller rest), and a deficit brings each to its class's largest frequency.

    frequencies has a row for each public item, which bounds the one ordered pass.
    """
    place = F.row_number().over(Window.orderBy(F.desc("frequency"), "item")) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy())
    last = F.greatest(F.floor(size / anonymity) - 1, F.lit(0))
    rows = frequencies.withColumn("class", F.least(F.floor(place / anonymity), last))
    return rows.withColumn("deficit", F.max("frequency").over(Window.partitionBy("class")) - F.col("frequency"))


def padding_rows(padded: DataFrame) -> DataFrame:
    """level and items of the fictitious transactions: level l has every item whose deficit is over l."""
    levels = padded.where("deficit > 0").select("item", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deficit") - 1)).alias("level"))
    return levels.groupBy("level").agg(F.array_sort(F.collect_list("item")).alias("items"))


def tid_intersections(long: DataFrame, max_size: int, limit: int) -> DataFrame:
    """labels and support of all itemsets of labels that occur, up to max_size; an error where they are more than limit.

    long has (tid, label). Levels are joined on tid by label order, so that each itemset of a row is
    made once; a row's labels are few (one for each attribute).
    """
    level = long.select("tid", F.array("label").alias("labels"), F.col("label").alias("last"))
    item = long.select("tid", "label")
    out = None
    for size in range(1, max_size + 1):
        if size > 1:
            level = level.join(item, "tid").where("label > last").select("tid", F.concat("labels", F.array("label")).alias("labels"), F.col("label").alias("last"))
        counts = level.groupBy("labels").agg(F.count(F.lit(1)).alias("support"))
        out = counts if out is None else out.union(counts)
    if out.limit(limit + 1).count() > limit:
        raise ValueError("more itemsets than the limit")
    return out


def join_owners(tables: Sequence[DataFrame], secret: str) -> DataFrame:
    """Owners' tables (tid, ...) joined on a keyed hash of tid, in full: a row that an owner lacks stays."""
    out = None
    for k, t in enumerate(tables):
        one = t.withColumn("htid", F.sha2(F.concat_ws("|", F.lit(secret), F.col("tid").cast("string")), 256)).drop("tid").withColumn(f"has{k}", F.lit(True))
        out = one if out is None else out.join(one, "htid", "full")
    return out


def publishable(requirements: Mapping[str, bool]) -> bool:
    return bool(requirements) and all(requirements.values())


@dataclass(frozen=True)
class Owner:
    """What an owner sends (records), and what it keeps: the names of its items and the answers to its checks."""

    records: DataFrame
    names: dict[str, str]
    frequent: set[frozenset]
    infrequent: set[frozenset]
    info: dict

    @property
    def asked(self) -> set[tuple[str, ...]]:
        """The itemsets that its checks need an answer to, in the cloud's labels."""
        return {tuple(sorted(s)) for p in self.frequent | self.infrequent for n in range(1, len(p) + 1) for s in itertools.combinations(p, n)}


def item_counts(wide: DataFrame) -> dict[Item, int]:
    """The rows of each item that occurs; as many entries as public items at most."""
    from .counts import histogram

    return {(r["attr"], r["value"]): r["n"] for r in histogram(wide).collect()}


def item_name(item: Item) -> str:
    return f"item:{item[0]}:{item[1]}"


def prepare_owner(wide: DataFrame, owner: int, attrs: Sequence[int], domain: Mapping[int, Sequence[int]], secret: bytes, public: PublicKey, threshold: int, anonymity: int = 2, width: int = 3, frequency: Mapping[Item, int] | None = None) -> Owner:
    """The rows that an owner sends to the cloud: htid, labels and the encrypted flag.

    Real rows and check rows have flag 1; padding rows, with which every item's frequency equals that of
    at least anonymity - 1 others, have flag 0. Items go by keyed labels, rows by a keyed hash of their
    id: real ones by the same in all owners' tables, added ones in a name space of the owner's own.
    frequency, of the owner's items, saves a pass over the rows. An item outside the domain is an error.
    """
    spark, n, salt = wide.sparkSession, public.n, secrets.token_bytes(32)
    public_items = [item_name((a, v)) for a in attrs for v in domain[a]]
    border = Border.of(owner, threshold, width)
    made = border.rows
    real = wide.select(F.concat(F.lit("real:"), F.col("tid").cast("string")).alias("id"), F.array(*(F.concat(F.lit(f"item:{a}:"), F.col(f"a{a}").cast("string")) for a in attrs)).alias("items"))
    copies = spark.createDataFrame([(k, list(r)) for k, r in enumerate(made)], "part int, items array<string>")
    checks = copies.select(F.explode(F.sequence(F.lit(0), F.lit(threshold))).alias("copy"), "part", "items")
    checks = checks.select(F.concat_ws(":", F.lit(f"check:{owner}"), "part", "copy").alias("id"), "items")
    if frequency is None:
        frequency = item_counts(wide.select("tid", *(f"a{a}" for a in attrs)))
    universe = dict.fromkeys(public_items, 0) | border.item_counts()
    universe.update((item_name((a, v)), frequency.get((a, v), 0)) for a in attrs for v in domain[a])
    padded = padding_table(spark.createDataFrame(sorted(universe.items()), "item string, frequency bigint"), anonymity)
    held = [(r["item"], r["frequency"], r["class"], r["deficit"]) for r in padded.collect()]  # a row for each public item
    padding = padding_rows(spark.createDataFrame(held, "item string, frequency bigint, class bigint, deficit bigint"))
    padding = padding.select(F.concat_ws(":", F.lit(f"padding:{owner}"), F.col("level").cast("string")).alias("id"), "items")
    names = {label_of(owner, item, salt): item for item, *_ in held}
    if len(names) < len(held):
        raise RuntimeError("two items have one label")
    by_item = {item: label for label, item in names.items()}
    rows = real.withColumn("flag", F.lit(1)).union(checks.withColumn("flag", F.lit(1))).union(padding.withColumn("flag", F.lit(0)))

    items, labels = (list(x) for x in zip(*sorted(by_item.items()), strict=True))
    sent = rows.select(F.lit(owner).alias("owner"), hashed_column(secret, F.col("id")).alias("htid"), "items", F.col("flag").cast("int").alias("flag"))

    def disguise(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            held = batch.column(2)
            places = pc.index_in(held.flatten(), pa.array(items))
            if places.null_count:
                raise ValueError("a row has an item that isn't public")
            own = pa.array(labels).take(places)
            ciphers = PublicKey(n).encrypt_all(batch.column(3).to_pylist())
            sizes = np.concatenate(([0], np.cumsum(pc.list_value_length(held).to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), own), pa.array(list(map(str, ciphers)))], ["owner", "htid", "labels", "cipher"])

    records = sent.mapInArrow(disguise, "owner int, htid binary, labels array<string>, cipher string").withColumn("labels", F.array_sort("labels"))

    def relabelled(sets: set[frozenset]) -> set[frozenset]:
        return {frozenset(by_item[x] for x in s) for s in sets}

    sizes: dict[int, int] = {}
    for _, _, group, _ in held:
        sizes[group] = sizes.get(group, 0) + 1
    info = {"owner": owner, "verification_rows": len(made) * (threshold + 1), "fictitious_rows": max((d for *_, d in held), default=0), "smallest_class": min(sizes.values(), default=0)}
    return Owner(records, names, relabelled(border.frequent), relabelled(border.infrequent), info)


def label_of(owner: int, item: str, salt: bytes) -> str:
    """A keyed name for an owner's item, which says nothing about it."""
    return hashlib.blake2b(f"{owner}|{item}".encode(), key=salt, digest_size=16).hexdigest()


@dataclass(frozen=True)
class Reply:
    """The cloud's answer for an itemset of labels: its encrypted support, and whether that is over the threshold."""

    labels: tuple[str, ...]
    support: int
    frequent: int


def cloud_mine(records: Sequence[DataFrame], asked: Sequence[tuple[str, ...]], label_owner: Mapping[str, int], compare: Comparison, threshold: int) -> list[Reply]:
    """Encrypted supports of itemsets of labels, from rows of labels and encrypted flags alone.

    A row counts where every owner of the itemset's labels says that it is real: the encrypted flags are
    added, and their sum compared with the number of owners less one. A record meets an owner's part of
    an itemset by the part's first label. Flags of itemsets of one owner are added in the task that meets
    them; of the others, one flag for each owner is gathered by hashed id. Sums pass on one number for
    each itemset and task. threshold is encrypted.
    """
    spark, public = records[0].sparkSession, compare.public
    square, parts = public.n * public.n, []
    for k, labels in enumerate(asked):
        by_owner: dict[int, list[str]] = {}
        for x in labels:
            by_owner.setdefault(label_owner[x], []).append(x)
        parts += [(k, len(by_owner), who, own[0], own[1:]) for who, own in by_owner.items()]
    table = spark.createDataFrame(parts, "candidate int, owners int, owner int, label string, others array<string>")
    cells = None
    for one in records:
        cells = one if cells is None else cells.union(one)
    cells = cells.select("owner", "htid", "cipher", "labels", F.explode("labels").alias("label")).join(F.broadcast(table), ["owner", "label"])  # as many rows as were asked for
    cells = cells.where(F.size(F.array_except("others", "labels")) == 0).select("candidate", "owners", "htid", "cipher")

    def alone(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        names, held = ["candidate", "owners", "htid", "cipher"], {}
        for batch in batches:
            one = pc.equal(batch.column(1), 1)
            rest = batch.filter(pc.invert(one))
            if rest.num_rows:
                yield rest
            _multiplied(held, batch.filter(one).column(0).to_pylist(), map(int, batch.filter(one).column(3).to_pylist()), square)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([1] * len(held), pa.int32()), pa.nulls(len(held), pa.binary()), pa.array(list(map(str, held.values())), pa.string())], names)

    # Comparisons are work of the processor: several even parts for each core, which aren't joined again however few bytes they have.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = cells.mapInArrow(alone, "candidate int, owners int, htid binary, cipher string").repartition(tasks, "candidate", "owners", "htid")
    met = met.groupBy("candidate", "owners", "htid").agg(F.collect_list("cipher").alias("flags")).where("owners = 1 or size(flags) = owners")

    def indicators(batches):
        import pyarrow as pa

        held: dict[int, int] = {}
        for batch in batches:
            which, owners, flags = (batch.column(k).to_pylist() for k in (0, 1, 3))
            totals = [math.prod(map(int, some)) % square for some in flags]
            joint = [k for k, n in enumerate(owners) if n > 1]
            for k, c in zip(joint, compare.greater_all([totals[k] for k in joint], [owners[k] - 1 for k in joint]), strict=True):
                totals[k] = c
            _multiplied(held, which, totals, square)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(map(str, held.values())), pa.string())], ["candidate", "cipher"])

    sums = _total_ciphers(met.mapInArrow(indicators, "candidate int, cipher string"), ["candidate"], public)
    found = {r["candidate"]: int(r["cipher"]) for r in sums.collect()}
    totals = [found.get(k) or public.encrypt(0) for k in range(len(asked))]
    return [Reply(*reply) for reply in zip(asked, totals, compare.over(totals, threshold), strict=True)]


def open_replies(replies: Sequence[Reply], owners: Sequence[Owner], private: PrivateKey, threshold: int) -> tuple[dict[Itemset, int], list[dict]]:
    """Supports of itemsets of real items, and the owners' checks; an answer that fails one is refused."""
    names = {label: item for o in owners for label, item in o.names.items()}
    returned, supports = set(), {}
    for r in replies:
        support, frequent = private.decrypt(r.support), private.decrypt(r.frequent)
        if frequent != int(support > threshold):
            raise RuntimeError("an encrypted comparison disagrees with its sum")
        if frequent:
            returned.add(frozenset(r.labels))
        plain = [names[x] for x in r.labels]
        if all(x.startswith("item:") for x in plain):
            supports[tuple(sorted((int(a), int(v)) for a, v in (x.split(":")[1:] for x in plain)))] = support
    checks = [check_answer(o.frequent, o.infrequent, returned) for o in owners]
    if not all(c["passed"] for c in checks):
        raise RuntimeError(f"the answer was refused: {checks}")
    return supports, checks


def encrypted_mining(wide: DataFrame, candidates: Sequence[Itemset], owner: Mapping[int, int], threshold: int, *, anonymity: int = 2, bits: int = 512, domain: Mapping[int, Sequence[int]] | None = None) -> tuple[dict[Itemset, int], dict]:
    """Supports of candidates that a cloud counts without seeing items, rows or supports, and the checks.

    Owners send disguised real, check and padding rows (prepare_owner), the cloud adds encrypted flags
    (cloud_mine), and what comes back is opened and checked (open_replies). Correctness only: the roles
    share a process, and one pattern for each owner doesn't find every omission.
    """
    frequency = item_counts(wide)  # one pass for the domain, all owners' padding and the number of rows
    if domain is None:
        domain = {a: sorted(v for at, v in frequency if at == a) for a in sorted(owner)}
    rows = sum(n for (a, _), n in frequency.items() if a == min(owner))
    public, private = key_pair(bits)
    secret = secrets.token_bytes(32)
    parts: dict[int, list[int]] = {}
    for attr, who in sorted(owner.items()):
        parts.setdefault(who, []).append(attr)
    owners = [prepare_owner(wide, who, attrs, domain, secret, public, threshold, anonymity, frequency=frequency) for who, attrs in sorted(parts.items())]
    label_owner = {label: who for who, o in zip(sorted(parts), owners, strict=True) for label in o.names}
    of_item = {item: label for o in owners for label, item in o.names.items()}
    asked = {tuple(sorted(of_item[item_name(i)] for i in c)) for c in candidates}.union(*(o.asked for o in owners))
    bound = max(rows + sum(o.info["verification_rows"] + o.info["fictitious_rows"] for o in owners), threshold, 1)
    compare = Comparison(public, private, bound, min(128, bits // 4))
    replies = cloud_mine([o.records for o in owners], sorted(asked), label_owner, compare, public.encrypt(threshold))
    supports, checks = open_replies(replies, owners, private, threshold)
    info = {"checks": checks, "replies": len(replies), "owners": [o.info for o in owners], "smallest_class": min(o.info["smallest_class"] for o in owners), "publication_eligible": False}
    return {c: supports[tuple(sorted(c))] for c in candidates}, info


#: Fixed value: bytes of one encrypted bit with 128-bit parameters.
CIPHER_BYTES = 2536


def payload_bytes(rows: int, items: int, candidates: int) -> int:
    """What the encrypted rows, queries, counters and answers of the circuits take."""
    width = rows.bit_length()
    return ((rows + candidates) * items + candidates * (width + 2) + width) * CIPHER_BYTES


def block_rows(rows: int, items: int, candidates: int, most: int) -> int:
    """How many of the rows can be encrypted at once in so many bytes, with queries, counters (as wide as all rows need) and answers."""
    width = rows.bit_length()
    rest = most // CIPHER_BYTES - candidates * items - candidates * (width + 2) - width
    return max(0, min(rows, rest // items if items else rest))


def circuit_mining(wide: DataFrame, candidates: Sequence[Itemset], owner: Mapping[int, int], domain: Mapping[int, Sequence[int]], threshold: int, most_gib: float = 4.0) -> tuple[dict[Itemset, int], dict]:
    """Supports of candidates as the Boolean circuits count them, with the gates that they take.

    Rows go through the circuits block by block (circuit_supports), as many at once as most_gib would hold as ciphertexts
    beside the queries and the counters; it is refused where not even one row fits. payload_bytes
    is what all rows would take, block_bytes what is held at once. The comparisons with the threshold go
    through their circuit and must agree with the counts. Gates are evaluated on bits in the clear: no library encrypts them.
    """
    rows, items = wide.count(), [(a, v) for a in sorted(domain) for v in domain[a]]
    payload = payload_bytes(rows, len(items), len(candidates))
    block = block_rows(rows, len(items), len(candidates), int(most_gib * (1 << 30)))
    if rows and not block:
        raise ValueError(f"{payload} bytes of ciphertext, and with one row at a time still over the limit of {most_gib:g} GiB")
    found = {r["candidate"]: r for r in circuit_supports(wide, items, candidates, max(1, min(block, 1 << 16))).collect()}
    supports = {c: found[k]["support"] for k, c in enumerate(candidates)}
    digits = max(rows, threshold).bit_length() or 1
    binary = lambda x: [int(b) for b in f"{x:0{digits}b}"]
    below = {c: less_circuit(binary(n), binary(threshold)) for c, n in supports.items()}
    above = {c: less_circuit(binary(threshold), binary(n)) for c, n in supports.items()}
    if any(below[c] != (n < threshold) or above[c] != (n > threshold) for c, n in supports.items()):
        raise RuntimeError("a comparison circuit disagrees")
    gates = {g: sum(r[f"{g}_gates"] for r in found.values()) for g in ("and", "or", "not", "xor")}
    held = payload - (rows - block) * len(items) * CIPHER_BYTES
    return supports, {"payload_bytes": payload, "blocks": -(-rows // block) if rows else 0, "block_bytes": held, "below": sum(below.values()), "above": sum(above.values()), "gates": gates, "owners": len(set(owner.values())), "publication_eligible": False}


def agreement(wide: DataFrame, supports: Mapping[Itemset, int], k: int, max_size: int, domain: dict[int, list[int]]) -> dict:
    """How the best of the counted itemsets agree with the exact top k of all; supports that aren't exact are an error."""
    from .counts import supports as exact_supports
    from .counts import top_itemsets

    exact = exact_supports(wide, list(supports))
    if wrong := [c for c, n in supports.items() if exact[c] != n]:
        raise RuntimeError(f"counted supports are wrong, of {wrong[:3]}")
    truth = [c for c, _ in top_itemsets(wide, k, max_size, domain=domain)[0]]
    best = sorted(supports, key=lambda c: (-supports[c], c))[:k]
    weight = {c: len(truth) - at for at, c in enumerate(truth)}
    both = len(set(truth) & set(best))
    return {"verified": len(exact), "truth": [[list(i) for i in c] for c in truth], "f1": 2 * both / max(len(truth) + len(best), 1), "ncr": sum(weight.get(c, 0) for c in best) / max(sum(weight.values()), 1)}
