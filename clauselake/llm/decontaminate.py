"""Benchmark decontamination by templates: copies and re-parameterised copies of benchmark items in documents.

Text becomes tokens (runs of letters, numbers). Numbers, names (capitalised words inside a sentence) and units (unit
words after a number) become typed placeholders, other words are lowered. Windows of five template tokens of items
and documents are joined by hash. Along one alignment of a document with an item, a slot value of the item must
always meet the same value in the document; windows that break this are dropped. A document is contaminated by an item
when the windows left cover at least 0.8 of the item's tokens, over all alignments together.

Texts have two readings, and items are compared with documents in each. In the second one the names are the
capitalised words that are none of ``COMMON``, also those that open a sentence, and names in a row are one placeholder
with the value of the first that is no title. A pair is reported by the first reading that finds it;
``item_tokens`` and ``covered`` count that reading's tokens, ``first_token`` and ``last_token`` always the first's. Items
shorter than a window have the first reading only.

Only windows whose hash may belong to the benchmark leave the scan: a bit table of fixed size, filled from the
benchmark, drops most others. Candidates come from rare windows alone: a document that covers 0.8 of an item shares a window
over one of any tokens that are one more than a fifth of the item's, so those tokens are taken whose windows are in the
fewest documents, and the distinct windows of documents meet the distinct windows over these tokens. A window that is
everywhere, and its places, meet nothing unless an item has no other. Each candidate is then aligned once, on the windows
of both texts.

Cases: null or blank texts match nothing; an item shorter than a window matches a document that is the same template
from end to end; a null doc_id or item_id is kept as null; repeated rows (equal id and text) count once in the findings
and go or stay together; empty tables give no findings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.llm.common import (
    BASE_INVERSE, LOWER, arrow_map, bounded, fresh_name, mix, powers, ragged, slice_end, small_side, staged, text_buffer,
)

WIDTH, COVERAGE = 5, 0.8
#: bits of the table that drops windows which no item has
TABLE_BITS = 1 << 22
#: windows of the benchmark that are broadcast at most
BROADCAST_WINDOWS = 500_000
#: pairs of windows that are compared at once while a candidate is aligned
PAIRS_AT_ONCE = 1_000_000
#: contaminated or candidate documents that are broadcast at most
BROADCAST_DOCUMENTS = 500_000
#: fixed values: words that are units after a number
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms ton tons "
    "tonne tonnes lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds "
    "min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars usd euro "
    "euros eur cent cents degree degrees kmh mph w kw kwh v hz khz mhz ghz kb mb gb tb"
).split()
#: fixed values: words that are no names in the second reading
COMMON = (
    "a about above after again all also although among an and another any are as at because before behind below besides "
    "between both but by calculate can compute consider could determine did do does down during each either enough even "
    "every everyone everything evaluate explain few finally find first for four five from give given had half has have he "
    "hence her here his how however i if in initially instead into is it its last later let like many meanwhile more most "
    "much must neither next no nobody none nor not nothing now of off on once one only or other otherwise our out over "
    "please prove second several shall she should show similarly simplify since six so solve some someone sometimes "
    "suppose ten than that the their them then there therefore these they third this those though three through thus to "
    "today together tomorrow twice two under unless until up upon use using was we were what when where whereas whether "
    "which while who whom whose why with within without write yes yesterday yet you your "
    "al algunos ante antes aunque como con cuando cuanto cada de del desde donde dos durante e el ella ellos en entre es "
    "esa ese eso esta este esto estos ha hasta hay la las le les lo los me mi mientras muy ni nos o para pero por porque "
    "pues que quien se si sin sobre son su sus tras tres tu un una uno unos y ya yo "
    "aber alle als am an auch auf aus bei bis da das dass dem den der des die dies diese dieser doch drei du durch ein "
    "eine einem einen einer er es es für gegen hat ich ihr im in ist jede jeder kein man mit nach nicht noch nun nur ob "
    "oder ohne seit sich sie sind so um und uns unter vom von vor wann warum was weil welche wenn wer wie wieviel wir wo "
    "zu zum zur zwei zwischen "
    "alors après au aussi avant avec car ce cela ces cet cette chaque chez ci combien comme comment dans de depuis des "
    "deux donc du elle elles en est et il ils je la le les leur lorsque mais ne nous on ou où par parce pas pendant plus "
    "pour pourquoi puis quand que quel quelle qui sa sans se selon ses si son sous sur ta tous tout trois tu un une vous"
).split()
#: fixed values: titles before a name
TITLES = "dr frau herr madame miss monsieur mr mrs ms prof professor señor señora".split()
NUMBER, NAME, UNIT = 1, 2, 3
_SLOTS = "array<long>"
_WINDOWS = f"id long, uid long, reading int, tokens int, at int, first int, last int, window long, slots {_SLOTS}"


def _word_hash(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)
    return int(mix(np.array([np.sum(powers(len(data)) * data, dtype=np.uint64)]))[0])


_COMMON, _TITLES = (np.array([_word_hash(w.encode()) for w in words], np.uint64) for words in (COMMON, TITLES))
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def template_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token the template code and the slot value (0 for words), and per text its first token (n + 1 entries)."""
    return _tokens(texts)[:3]


def _tokens(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """As ``template_tokens``, and per token its word's value, its first byte and the byte after it, and whether it is a
    capitalised word without another type, and opens a sentence."""
    data, bounds = text_buffer(texts)
    codes, values, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    words, ends, capitals, openings = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, bool)]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds] = True
    units = np.array([_word_hash(u.encode()) for u in UNITS], np.uint64)
    at, opens, after_number = 0, True, False
    while at < len(data):
        end = slice_end(data, fresh, at)
        part, new = data[at:end], fresh[at:end]
        kind = _KIND[part].copy()
        if len(part) > 2:  # a point or comma between digits belongs to the number
            joint = ((part[1:-1] == 46) | (part[1:-1] == 44)) & (kind[:-2] == 2) & (kind[2:] == 2) & ~new[1:-1] & ~new[2:]
            kind[1:-1][joint] = 2
        first = kind > 0
        first[1:] &= (kind[1:] != kind[:-1]) | new[1:]
        starts = np.flatnonzero(first)
        if len(starts):
            begin = starts[0]
            tail = np.diff(starts, append=len(part))
            inside = np.arange(begin, len(part)) - np.repeat(starts, tail)
            value = powers(int(tail.max()))[inside] * (LOWER[part[begin:]].astype(np.uint64) + np.uint64(1))
            value[kind[begin:] == 0] = 0
            value = mix(np.add.reduceat(value, starts - begin))
            stops = np.concatenate([[0], np.cumsum((_STOP[part] & (kind == 0)) | new)])
            # a token opens a sentence when a stop or a text's start lies after the token before it
            opening = np.diff(stops[starts + 1], prepend=0 if not opens else -1) > 0
            number = kind[starts] == 2
            second = part[np.minimum(starts + 1, len(part) - 1)]
            small = (starts + 1 < len(part)) & ((second >= 97) & (second < 123) | (second >= 128)) & (tail > 1)
            capital = (part[starts] >= 65) & (part[starts] < 91) & small
            name = capital & ~opening
            before = np.concatenate([[after_number], number[:-1]]) & ~(np.diff(np.concatenate([[0], np.cumsum(new)])[starts + 1], prepend=0) > 0)
            unit = before & ~number & np.isin(value, units)
            code = np.select([number, unit, name], [np.uint64(NUMBER), np.uint64(UNIT), np.uint64(NAME)], value).astype(np.uint64)
            codes.append(code)
            values.append(np.where(number | unit | name, value | np.uint64(1), np.uint64(0)))
            places.append(starts + at)
            words.append(value)
            ends.append(starts + at + np.add.reduceat((kind > 0).astype(np.int64), starts))
            capitals.append(capital & ~number & ~unit)
            openings.append(opening)
            opens, after_number = bool(stops[-1] > stops[starts[-1] + 1]), bool(number[-1])
        at = end
    starts = np.concatenate(places)
    more = [np.concatenate(words), starts, np.concatenate(ends), np.concatenate(capitals), np.concatenate(openings)]
    return np.concatenate(codes), np.concatenate(values), np.searchsorted(starts, bounds), *more


def readings(texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Both readings: code and value per token, first token per text, and the first reading's token that each begins at
    (one entry more than tokens)."""
    code, value, first, word, start, end, capital, opening = _tokens(texts)
    yield code, value, first, np.arange(len(code) + 1)
    n = len(code)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    capitals = np.flatnonzero(capital)
    name, title = np.zeros(n, bool), np.zeros(n, bool)
    name[capitals] = ~np.isin(word[capitals], _COMMON)
    title[capitals] = np.isin(word[capitals], _TITLES)
    follows = np.zeros(n, bool)
    gap = start[1:] - end[:-1]
    near = ((gap == 1) & ~opening[1:]) | ((gap <= 2) & title[:-1])
    follows[1:] = name[1:] & name[:-1] & (text[1:] == text[:-1]) & near
    at = np.flatnonzero(~follows)
    code = np.where(name, np.uint64(NAME), np.where(capital, word, code))
    value = np.where(name, word | np.uint64(1), np.where(capital, np.uint64(0), value))
    # the run's value is that of its first name after titles
    run = np.cumsum(~follows) - 1
    speaks = np.flatnonzero(name & ~title)[::-1]
    value = value.copy()
    value[at[run[speaks]]] = value[speaks]
    yield code[at], value[at], np.searchsorted(at, first), np.append(at, n)


def window_rows(rows: DataFrame, table: np.ndarray | None) -> DataFrame:
    """Windows of ``text``: id, uid, reading, the text's tokens and the place in it, first and last token of the first
    reading, hash and the window's slot values in order."""

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if table is None else np.unpackbits(table, bitorder="little").view(bool)
        for batch in (part for whole in batches for part in bounded(whole)):
            base = None
            for reading, (code, value, first, origin) in enumerate(readings(batch.column("text"))):
                base = first if base is None else base
                n = np.diff(first)
                each = np.where(n >= WIDTH, n - WIDTH + 1, ((n > 0) & (reading == 0)).astype(np.int64))
                start = ragged(first[:-1], each)
                doc = np.repeat(np.arange(len(n)), each)
                length = np.minimum(n, WIDTH)[doc]
                prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(code) * powers(len(code))[: len(code)], dtype=np.uint64)])
                window = mix((prefix[start + length] - prefix[start]) * powers(len(code) + 1, BASE_INVERSE)[start])
                window = mix(window ^ (length + 256 * reading).astype(np.uint64))
                if known is not None:
                    kept = known[(window % np.uint64(TABLE_BITS)).astype(np.int64)]
                    start, doc, length, window = start[kept], doc[kept], length[kept], window[kept]
                reach = ragged(start, length)
                slots = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(value[reach].view(np.int64)))
                take = pa.array(doc)
                out = pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("uid").take(take), pa.array(np.full(len(doc), reading), pa.int32()), pa.array(n[doc], pa.int32()),
                     pa.array(start - first[doc], pa.int32()), pa.array(origin[start] - base[doc], pa.int32()), pa.array(origin[start + length] - 1 - base[doc], pa.int32()),
                     pa.array(window.view(np.int64)), slots],
                    ["id", "uid", "reading", "tokens", "at", "first", "last", "window", "slots"],
                )
                for k in range(0, out.num_rows, 100_000):
                    yield out.slice(k, 100_000)

    return arrow_map(rows.select("id", "uid", F.coalesce("text", F.lit("")).alias("text")), windows, _WINDOWS)


def _uid(key: str) -> Column:
    return F.xxhash64(key, "text")


def bit_table(items: DataFrame) -> np.ndarray:
    """The bits of all windows of the benchmark, as bytes; they reach the driver as a few bitmaps of fixed size."""
    bit = F.pmod("window", F.lit(TABLE_BITS)) + 1
    maps = items.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("position"))
    maps = maps.groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("bits"))
    table = np.zeros(TABLE_BITS // 8, np.uint8)
    for row in maps.collect():  # TABLE_BITS / 32768 rows at most
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        start = (row["bucket"] - 1) * len(part)
        table[start : start + len(part)] = part[: len(table) - start]
    return table


def rare_windows(items: DataFrame, frequency: DataFrame, coverage: float) -> DataFrame:
    """Windows of each item of which a contaminated document has one at least: item_uid, item_id, reading, window.

    A document that covers the share of an item's tokens leaves few uncovered. Of any tokens that are one more than those
    few, one is covered, by a window over it; the tokens whose windows are in the fewest documents are taken.
    """
    places = items.join(frequency, ["window", "reading"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    length = F.least(F.lit(WIDTH), F.col("tokens"))
    tokens = places.withColumn("token", F.explode(F.sequence(F.col("at"), F.col("at") + length - 1)))
    cost = tokens.groupBy("id", "uid", "reading", "tokens", "token").agg(F.sum("n").alias("cost"))
    order = Window.partitionBy("id", "uid", "reading").orderBy("cost", "token")
    spare = F.col("tokens") - F.ceil(F.lit(coverage) * F.col("tokens") - F.lit(1e-9))
    taken = cost.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= spare + 1)
    chosen = tokens.join(taken.select("id", "uid", "reading", "token"), ["uid", "reading", "token"], "left_semi")
    return chosen.filter("n > 0").select(F.col("id").alias("item_id"), F.col("uid").alias("item_uid"), "reading", "window").distinct()


_ALIGNED = "covered int, windows int, first_token int, last_token int, reparameterised boolean"


def aligned(doc: dict, item: dict) -> tuple[int, int, int, int, bool] | None:
    """The item's tokens that the document covers: windows of both (at, window, slots; the document's also first, last)
    meet, and of each alignment those are dropped that give one of the item's slot values two values in the document."""
    order = np.argsort(doc["window"], kind="stable")
    low = np.searchsorted(doc["window"][order], item["window"], "left")
    each = np.searchsorted(doc["window"][order], item["window"], "right") - low
    if not each.any():
        return None
    places, first, last, changed = [np.zeros(0, np.int64)], np.iinfo(np.int32).max, -1, False
    shifts = (int(doc["at"].min()) - int(item["at"].max()), int(doc["at"].max()) - int(item["at"].min()) + 1)
    values, code = np.unique(item["slots"], return_inverse=True)
    code = code.reshape(item["slots"].shape)
    span = shifts[1] - shifts[0]
    step = max(1, min(span, span * PAIRS_AT_ONCE // max(1, int(each.sum())), 4 * PAIRS_AT_ONCE // len(values)))
    for start in range(shifts[0], shifts[1], step):  # all of an alignment at once, some alignments at a time
        if step < span:  # in ``order`` equal windows ascend by place, so a run of places is a range
            within = lambda edge: _count_before(doc, order, low, each, item["at"] + edge)  # noqa: B023, E731
            lo, n = low + within(start), within(start + step) - within(start)
        else:
            lo, n = low, each
        q = np.repeat(np.arange(len(n)), n)
        p = order[ragged(lo, n)]
        if not len(q):
            continue
        shift = doc["at"][p] - item["at"][q]
        was, now = item["slots"][q], doc["slots"][p]
        pair, k = np.nonzero(was != 0)
        odd = np.zeros(len(q), bool)
        if len(pair):  # a key for each alignment and slot value; a key with two values is odd
            group, value = (shift[pair] - start) * len(values) + code[q[pair], k], now[pair, k]
            one = np.zeros((min(start + step, shifts[1]) - start) * len(values), np.int64)
            one[group] = value
            two = np.zeros(len(one), bool)
            two[group[one[group] != value]] = True
            odd[pair[two[group]]] = True
        p, q = p[~odd], q[~odd]
        if len(q):
            places.append(np.unique(item["at"][q]))
            first, last = min(first, int(doc["first"][p].min())), max(last, int(doc["last"][p].max()))
            changed |= bool(((item["slots"][q] != 0) & (item["slots"][q] != doc["slots"][p])).any())
    found = np.unique(np.concatenate(places))
    if not len(found):
        return None
    width = min(WIDTH, item["tokens"])
    covered = len(np.unique((found[:, None] + np.arange(width)).ravel()))
    return covered, len(found), first, last, changed


def _count_before(doc: dict, order: np.ndarray, low: np.ndarray, each: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How many of the document's places of each item window (``order[low : low + each]``, ascending) are below ``place``."""
    left, right = low.copy(), low + each
    at = doc["at"][order]
    while (left < right).any():
        middle = (left + right) >> 1
        less = (left < right) & (at[np.minimum(middle, len(at) - 1)] < place)
        left, right = np.where(less, middle + 1, left), np.where((left < right) & ~less, middle, right)
    return left - low


def _window_arrays(cell: pa.Array, tokens: int) -> dict:
    """The windows of one text, places ascending; slots padded to WIDTH."""
    flat = cell.flatten()
    numbers = {n: flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("at", "first", "last", "window")}
    width = min(WIDTH, tokens)
    slots = np.zeros((len(numbers["at"]), WIDTH), np.int64)
    slots[:, :width] = flat.field("slots").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    order = np.argsort(numbers["at"], kind="stable")
    return {n: v[order] for n, v in numbers.items()} | {"slots": slots[order], "tokens": tokens}


def find(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Contaminated documents and their items: doc_id, uid, item_id, item_tokens, covered, coverage, windows,
    first_token, last_token (in the document) and reparameterised (slot values were exchanged)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").distinct().withColumn("uid", _uid("id"))
    items = staged(window_rows(items, None), "benchmark-windows")
    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).withColumn("uid", _uid("id"))
    mine = staged(window_rows(named, bit_table(items)), "document-windows")
    # candidates: documents that hold a rare window of an item, each once, whatever the places
    held = mine.select("uid", "reading", "window").distinct()
    frequency = held.groupBy("window", "reading").agg(F.count("*").alias("n"))
    rare = staged(rare_windows(items, frequency, coverage), "rare-windows")
    pairs = held.join(small_side(rare, BROADCAST_WINDOWS), ["window", "reading"]).select("uid", "reading", "item_uid").distinct()
    pairs = staged(pairs, "candidates")
    # each candidate is aligned once, on the windows of both
    listed = F.collect_list(F.struct("at", "first", "last", "window", "slots"))  # of one text
    wanted = mine.join(small_side(pairs.select("uid", "reading").distinct(), BROADCAST_DOCUMENTS), ["uid", "reading"], "left_semi")
    texts = wanted.dropDuplicates(["uid", "reading", "at"]).groupBy("uid", "reading", "tokens").agg(F.min("id").alias("id"), listed.alias("theirs"))
    asked = items.groupBy(F.col("uid").alias("item_uid"), "reading", F.col("tokens").alias("item_tokens")).agg(F.min("id").alias("item_id"), listed.alias("own"))
    met = pairs.join(texts, ["uid", "reading"]).join(asked, ["item_uid", "reading"])
    met = met.filter((F.col("item_tokens") >= WIDTH) | (F.col("item_tokens") == F.col("tokens")))

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ["uid", "id", "item_uid", "item_id", "reading", "item_tokens"]
        for batch in batches:
            sizes = {n: batch.column(n).to_pylist() for n in ("tokens", "item_tokens")}
            rows = []
            for i in range(batch.num_rows):
                theirs, own = (_window_arrays(batch.column(c).slice(i, 1), sizes[n][i]) for c, n in (("theirs", "tokens"), ("own", "item_tokens")))
                rows.append(aligned(theirs, own))
            some = pa.array([i for i, r in enumerate(rows) if r is not None], pa.int64())
            columns = list(zip(*(r for r in rows if r is not None), strict=True)) or [()] * 5
            kinds = [pa.int32()] * 4 + [pa.bool_()]
            names = [*kept, "covered", "windows", "first_token", "last_token", "reparameterised"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(some) for c in kept], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    whole = met.mapInArrow(align, f"uid long, id long, item_uid long, item_id long, reading int, item_tokens int, {_ALIGNED}")
    whole = whole.withColumn("coverage", F.col("covered") / F.col("item_tokens")).filter(F.col("coverage") >= coverage)
    found = F.min(F.struct("reading", "item_tokens", "covered", "coverage", "windows", "first_token", "last_token", "reparameterised"))
    whole = whole.groupBy("id", "uid", "item_id", "item_uid").agg(found.alias("f"))
    return whole.select(
        F.col("id").alias("doc_id"), "uid", "item_id", "f.item_tokens", "f.covered", "f.coverage", "f.windows", "f.first_token", "f.last_token", "f.reparameterised"
    )


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that no benchmark item contaminates, with all their columns."""
    key, uid = fresh_name(docs, "bad_id"), fresh_name(docs, "bad_uid")
    found = find(docs, benchmark, coverage).select(F.col("doc_id").alias(key), F.col("uid").alias(uid)).distinct()
    side = small_side(staged(found, "contaminated"), BROADCAST_DOCUMENTS)
    own = F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return docs.join(side, docs["doc_id"].cast("long").eqNullSafe(F.col(key)) & (own == F.col(uid)), "left_anti")
