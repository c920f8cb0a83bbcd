"""Fingerprints of review reports: a Merkle tree over sections, paragraphs and pieces of sentences.

A text is cut at blank lines into sections, at line ends into paragraphs and at sentence ends into pieces of bounded
length; the cuts lose nothing, so two texts are equal exactly if their roots are. A node is the hash of its children. The
fingerprint is the tree as text: the root in full, inner nodes and leaves by their first eight digits. Comparing two
fingerprints starts at the roots and goes down into branches that differ only, which also tells where an edit lies.
"""
from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siliscope.llm.common import pieces, small_batches, tasks, text_of

PIECE = 6  # code points of a leaf at most, whatever the text's length, so that any two texts can share leaves
SHORT = 8  # digits of an inner node


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _leaves(paragraph: str) -> list[str]:
    out = []
    for sentence in paragraph.split(". "):
        if len(sentence) <= PIECE:
            out.append(sentence)
        else:
            out += [sentence[i:i + PIECE] for i in range(0, len(sentence), PIECE)]
        out[-1] += ". "
    out[-1] = out[-1][:-2]
    return out


def fingerprint(text: str) -> str:
    """``root:section[paragraph(leaf.leaf),...];...``; equal for equal texts alone."""
    sections, nodes = [], []
    for section in text.split("\n\n"):
        paragraphs, hashes = [], []
        for paragraph in section.split("\n"):
            leaves = [_hash(p.encode()) for p in _leaves(paragraph)]
            node = _hash(b"p" + b"".join(leaves))
            hashes.append(node)
            paragraphs.append(f"{node.hex()[:SHORT]}({'.'.join([x.hex()[:SHORT] for x in leaves])})")
        node = _hash(b"s" + b"".join(hashes))
        nodes.append(node)
        sections.append(f"{node.hex()[:SHORT]}[{','.join(paragraphs)}]")
    root = hashlib.sha256(b"r" + b"".join(nodes)).hexdigest()
    return f"{root}:{';'.join(sections)}"


def _sections(mark: str) -> list[tuple[str, str]]:
    return [(s[:SHORT], s[SHORT + 1:-1]) for s in mark.partition(":")[2].split(";")]


def _paragraphs(body: str) -> list[tuple[str, list[str]]]:
    return [(p[:SHORT], p[SHORT + 1:-1].split(".")) for p in body.split(",")]


def _unmatched(a: list[tuple], b: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Branches of either side whose hash the other side lacks, counting repeats."""
    left, right = Counter(x[0] for x in a), Counter(x[0] for x in b)
    more, less = left - right, right - left
    out = ([], [])
    for side, items, over in ((0, a, more), (1, b, less)):
        for x in reversed(items):
            if over.get(x[0], 0) > 0:
                over[x[0]] -= 1
                out[side].append(x)
        out[side].reverse()
    return out


def likeness(a: str, b: str) -> float:
    """Share of leaves that two fingerprints have in common, from 0 to 1; 1 if the roots are equal, below 1 otherwise."""
    if a[:64] == b[:64]:
        return 1.0
    total = a.count(".") + a.count("(") + b.count(".") + b.count("(")
    differ = [[], []]
    rest = _unmatched(_sections(a), _sections(b))
    rest = _unmatched(*[[p for s in side for p in _paragraphs(s[1])] for side in rest])
    for side in (0, 1):
        for _, leaves in rest[side]:
            differ[side] += leaves
    common = sum((Counter(differ[0]) & Counter(differ[1])).values())
    return min(1 - 1 / (total + 1), (total - len(differ[0]) - len(differ[1]) + 2 * common) / total)


def edits(a: str, b: str) -> list[tuple[int, int, int]]:
    """Where b differs from a: (section, paragraph, leaf) places of a whose leaf b lacks at that place, from 0."""
    if a[:64] == b[:64]:
        return []
    out, other = [], _sections(b)
    for i, (node, body) in enumerate(_sections(a)):
        if i < len(other) and other[i][0] == node:
            continue
        theirs = _paragraphs(other[i][1]) if i < len(other) else []
        for j, (mark, leaves) in enumerate(_paragraphs(body)):
            if j < len(theirs) and theirs[j][0] == mark:
                continue
            against = theirs[j][1] if j < len(theirs) else []
            out += [(i, j, k) for k, leaf in enumerate(leaves) if k >= len(against) or against[k] != leaf]
    return out


def fingerprints(reviews: DataFrame, comment: str = "safe_comment") -> DataFrame:
    """Add ``fingerprint`` to every row; a missing comment is an empty text. Other columns pass through, none is shuffled."""
    names = [c for c in reviews.columns if c != "fingerprint"]
    held = reviews.select(*names, text_of(comment).alias("__text"))
    schema = reviews.select(*names, F.lit("").alias("fingerprint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks, pa.string())], [*names, "fingerprint"])

    return held.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as many code points from the start of the text that follows it."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


OUT = ("line_no long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
       "near_next double")


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in falling order, the last one a guest that only lends its text."""
    last, rows, held = None, [], 0
    names = [x.split()[0] for x in OUT.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in OUT.split(", ")]
    for batch in batches:
        for bucket, guest, number, text in zip(*(batch.column(c) for c in ("bucket", "guest", "line_no", "text"))):
            bucket, text = bucket.as_py(), text.as_py()
            mark = fingerprint(text)
            if last is not None and last[0] == bucket:
                _, own, before, own_mark = last
                changed = edited(before, text)
                changed_mark = fingerprint(changed)
                rows.append((own, len(before), hashlib.sha256(changed.encode()).hexdigest(), own_mark, changed_mark,
                             likeness(own_mark, changed_mark), likeness(own_mark, mark)))
                held += len(own_mark) + len(changed_mark)
            last = None if guest.as_py() else (bucket, number.as_py(), text, mark)
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def edit_report(reviews: DataFrame, line_no: str = "line_no", comment: str = "safe_comment") -> DataFrame:
    """Fingerprint of every report, of its edited text, and how like they are; also how like the next report is.

    The next report is the one with the next smaller ``line_no``; after the smallest comes the largest. Returns
    ``line_no, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, a row per input row. A
    missing comment is empty. Rows without a number stand after the smallest one; rows that share a number follow one another,
    larger text first. A report alone follows itself. ``line_no`` is a whole number.

    Texts are shuffled once, by ranges of the number; the range's neighbour sends a copy of one report, so no range waits for
    another and none is held whole in memory.
    """
    small_batches(reviews)
    rows = reviews.select(F.col(line_no).cast("long").alias("line_no"), text_of(comment).alias("text"))
    number = F.coalesce(F.col("line_no"), F.lit(-2 ** 63))
    slim = reviews.select(F.col(line_no).cast("long").alias("line_no")).select(number.alias("place"))
    many = max(2, min(4096, 4 * tasks(reviews)))
    bounds = slim.agg(F.percentile_approx("place", [i / many for i in range(1, many)], 10 * many)).first()[0] or []
    bounds = sorted(set(bounds))
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    # binary search among the sorted bounds: how many lie below
    bucket = F.expr("0")
    if bounds:
        low, high = F.lit(0), F.lit(len(bounds))
        state = F.struct(low.alias("lo"), high.alias("hi"))
        step = lambda s, _: F.when(s.lo >= s.hi, s).otherwise(F.when(
            F.get(edges, F.floor((s.lo + s.hi) / 2).cast("int")) < F.col("place"),
            F.struct((F.floor((s.lo + s.hi) / 2).cast("int") + 1).alias("lo"), s.hi.alias("hi"))).otherwise(
            F.struct(s.lo.alias("lo"), F.floor((s.lo + s.hi) / 2).cast("int").alias("hi"))))
        bucket = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), state, step, lambda s: s.lo)
    # the largest number of each range: at most as many rows as ranges
    tops = sorted((r.bucket, r.top) for r in slim.withColumn("bucket", bucket).groupBy("bucket").agg(F.max("place").alias("top")).collect())
    if not tops:
        return reviews.sparkSession.createDataFrame([], OUT)
    lends = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}
    placed = rows.withColumn("place", number).withColumn("bucket", bucket)
    digest = F.sha2("text", 256)
    # of the rows that share a range's largest number the one that sorts first is lent
    heads = placed.filter(F.col("place").isin(list(lends))).groupBy("place").agg(F.max(F.struct(digest.alias("d"), "text")).alias("r"))
    to = F.create_map(*[F.lit(x) for pair in lends.items() for x in pair])
    guests = heads.select(F.lit(None).cast("long").alias("line_no"), "r.text", F.lit(-2 ** 63).alias("place"),
                          F.try_element_at(to, F.col("place")).alias("bucket"), F.lit(True).alias("guest"))
    all_rows = placed.withColumn("guest", F.lit(False)).unionByName(guests)
    dealt = all_rows.repartition(pieces(len(tops), 1), "bucket").sortWithinPartitions(
        "bucket", "guest", F.desc("place"), F.desc(F.sha2("text", 256)))
    return dealt.select("bucket", "guest", "line_no", "text").mapInArrow(_report, OUT)
