"""Token ids, ORC files and packing, against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest
from py4j.java_gateway import get_field
from tokenizers import Tokenizer

from notewright.llm.packing import GAP, best_fit, pack_documents, pack_histogram, solve_program
from notewright.llm.token_orc import read_token_orc, token_digests, write_token_orc
from notewright.llm.tokens import Encoder, tokenizer_path

TEXTS = ["Hello world", None, "", "a  b\n\nc", "tabs\tand \n lines", "x" * 3000, "The the the. (Of) it's\nNew line &&& word%%%", "中文 text é　z <|endoftext|>", " lead", "trail ", "Hello world"]
FAR = 1 << 40  #: numbers from here on are longs to the gateway too


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_encoder_is_the_tokenizer():
    r = random.Random(2)
    encoder = Encoder(tokenizer_path())
    parts = [*"ab'\n\t 1.é<|²٣", "　", "\xa0", "\x1c", "​", "᠎", "  ", "'s", "word", " word", "%%%", "<|endoftext|>", "\r\n", "\U0001f600", "Ünder"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(20_000)]
    plain = [np.array(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    assert [encoder.encode(t) for t in texts] == plain
    assert encoder.encode("<|endoftext|>") == np.array([50256], "<u4").tobytes()
    assert encoder.encode("a <|endoftext|> b\n<|endoftext|>")[-4:] == np.array([50256], "<u4").tobytes()


def test_orc_round_trip(spark, make, tmp_path, ids):
    keys = [50, 3, 7, None, 9, 2, 1, 30, 31, 32, 33]
    path = str(tmp_path / "orc")
    write_token_orc(make(TEXTS, keys), path)
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0))
    start, expected = 0, []
    for i in order:
        x = ids(TEXTS[i])
        expected.append((keys[i], start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(map(tuple, token_digests(spark, path).collect()), key=repr) == sorted(expected, key=repr)
    stored = read_token_orc(spark, path)
    assert [list(r.ids) for r in stored.where("doc_id = 7").collect()] == [ids(TEXTS[2]).tolist()]
    assert "EqualTo(doc_id,7)" in stored.where("doc_id = 7")._jdf.queryExecution().executedPlan().toString()


def test_orc_files_have_indexes(spark, make, tmp_path):
    """Spark's own ORC library reads stripes, row index and Bloom filters of the files, and prunes row groups by them."""
    path = tmp_path / "orc"
    write_token_orc(make([f"text {i}" for i in range(5000)], [FAR + 2 * i for i in range(5000)]), str(path))
    jvm, seen = spark._jvm, 0
    for f in path.glob("*.orc"):
        conf = spark._jsc.hadoopConfiguration()
        file = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert file.getCompressionKind().toString() == "ZSTD" and file.getRowIndexStride() == 1000
        names = list(file.getSchema().getFieldNames())
        column = names.index("doc_id") + 1
        assert list(file.getSchema().getChildren())[column - 1].toString() == "bigint"
        rows = file.rows()
        for i, stripe in enumerate(file.getStripes()):
            footer = rows.readStripeFooter(stripe)
            kinds = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
            assert {(column, "ROW_INDEX"), (column, "BLOOM_FILTER_UTF8")} <= kinds
            assert footer.getColumns(column).getKind().toString() == "DIRECT_V2"  # run lengths
            assert file.getStripeStatistics().get(i).getColumnStatistics()[column].getMinimum() is not None
            seen += stripe.getNumberOfRows()
        rows.close()
    assert seen == 5000
    # An even number is in one group of 1000 rows; an odd one in none, by the Bloom filters.
    whole, one, none = (_rows_read(spark, path, x) for x in (None, FAR + 2 * 1234, FAR + 2 * 1234 + 1))
    assert whole == 5000 and 0 < one <= 1000 and none == 0


def _rows_read(spark, path, doc_id):
    """Rows that the ORC reader hands out under a search argument for doc_id."""
    jvm, count = spark._jvm, 0
    sarg = jvm.org.apache.hadoop.hive.ql.io.sarg
    for f in path.glob("*.orc"):
        file = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        options = file.options()
        if doc_id is not None:
            kind = getattr(jvm, "org.apache.hadoop.hive.ql.io.sarg.PredicateLeaf$Type").LONG
            options = options.searchArgument(sarg.SearchArgumentFactory.newBuilder().startAnd().equals("doc_id", kind, doc_id).end().build(), spark._sc._gateway.new_array(jvm.java.lang.String, 0))
        rows, batch = file.rows(options), file.getSchema().createRowBatch()
        while rows.nextBatch(batch):
            count += get_field(batch, "size")
        rows.close()
    return count


def test_orc_of_repeated_rows_and_of_none(spark, make, tmp_path):
    write_token_orc(make(["a b", "a b", "a b"], [4, 4, 4]), str(tmp_path / "a"))
    rows = sorted(map(tuple, token_digests(spark, str(tmp_path / "a")).collect()))
    assert [r[1] for r in rows] == [0, rows[0][2], 2 * rows[0][2]]
    write_token_orc(make([]), str(tmp_path / "b"))
    assert token_digests(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing_is_gapless_and_whole(make, ids, capacity):
    r = random.Random(1)
    texts = TEXTS + [" ".join(r.choice(["the", "of", "zebra", "x1"]) for _ in range(r.randint(1, 40))) for _ in range(120)]
    rows = pack_documents(make(texts), capacity).collect()
    by_doc, by_sequence = {}, {}
    for x in rows:
        by_doc.setdefault(x.doc_id, []).append(x)
        by_sequence.setdefault(x.sequence_id, []).append(x)
    for i, t in enumerate(texts):
        whole, pieces = ids(t), sorted(by_doc[i], key=lambda x: x.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert len(pieces) == -(-len(whole) // capacity) and all(p.length == capacity for p in pieces[1:])
        at = 0
        for p in pieces:
            assert p.start == at and p.ids_crc32 == zlib.crc32(whole[at : at + p.length].tobytes())
            at += p.length
        assert at == len(whole)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda x: x.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    total = sum(x.length for x in rows)
    assert len(by_sequence) <= -(-total // capacity) * 1.03 + 1


def test_packing_of_nothing(make):
    assert pack_documents(make([])).count() == 0


@pytest.mark.parametrize("kind", ["uniform", "middle", "hard", "few", "one"])
def test_plans_use_every_length_once(kind):
    r = np.random.RandomState(0)
    x = {"uniform": r.randint(1, 257, 4000), "middle": r.randint(70, 180, 3000), "hard": r.randint(86, 130, 900), "few": r.randint(1, 257, 9), "one": np.full(7, 256)}[kind]
    counts = dict(zip(*(v.tolist() for v in np.unique(x, return_counts=True))))
    plan = pack_histogram(counts, 256)
    used = {}
    for config, n in plan:
        assert sum(k * v for k, v in config) <= 256 and n > 0
        for k, v in config:
            used[k] = used.get(k, 0) + n * v
    assert used == counts
    sequences = sum(n for _, n in plan)
    assert sequences <= len(best_fit(counts, 256)) * 1.005 + 1


@pytest.mark.parametrize(("counts", "least"), [({516: 360, 260: 360, 258: 360, 250: 720}, 540), ({514: 600, 260: 600, 258: 600, 252: 1200}, 900), ({342: 300, 341: 301, 340: 302, 512: 100, 171: 700, 170: 500}, 551)])
def test_the_program_beats_best_fit(counts, least):
    """Histograms that best fit packs badly; `least` is the sum of lengths over the capacity, rounded up."""
    program = solve_program(counts, 1024)
    assert program.sequences <= (1 + GAP) * program.bound and program.bound <= least
    assert all(sum(k * v for k, v in c) <= 1024 for c in program.cover)
    for k, v in counts.items():
        assert sum(dict(c).get(k, 0) * x for c, x in program.cover.items()) >= v * (1 - 1e-9)
    assert sum(n for _, n in pack_histogram(counts, 1024)) == least == -(-sum(k * v for k, v in counts.items()) // 1024) < 0.97 * len(best_fit(counts, 1024))


def test_covers_are_within_the_gap():
    """Histograms of hundreds of lengths: the cover is exact and near the bound, the plan no worse than best fit's."""
    r = np.random.RandomState(0)
    for x, better in ((r.randint(200, 701, 20_000), 50), (np.clip(np.exp(r.normal(5.5, 0.7, 20_000)).astype(int), 1, 1024), 0), (r.randint(1, 1025, 3000), 0)):
        counts = dict(zip(*(v.tolist() for v in np.unique(x, return_counts=True))))
        program = solve_program(counts, 1024)
        assert program.gap <= GAP and program.bound >= x.sum() / 1024 - 1e-6
        covered = {}
        for config, n in program.cover.items():
            assert n > 0 and sum(k * v for k, v in config) <= 1024
            for k, v in config:
                covered[k] = covered.get(k, 0) + n * v
        assert covered == pytest.approx(counts)
        assert sum(n for _, n in pack_histogram(counts, 1024)) <= len(best_fit(counts, 1024)) - better


def test_packing_of_rows_without_an_id_and_of_repeated_rows(make, ids):
    texts, keys = ["a b c"] * 3 + [None, "", "x " * 40, "x " * 40], [None, 4, 4, None, 5, 6, 6]
    rows = pack_documents(make(texts, keys), 16).collect()
    wanted = []
    for t, k in zip(texts, keys):
        n = len(ids(t))
        wanted += [(k, n - max(0, (n - 1) // 16) * 16)] + [(k, 16)] * ((n - 1) // 16)
    assert sorted(((r.doc_id, r.length) for r in rows), key=repr) == sorted(wanted, key=repr)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_lengths_must_fit():
    with pytest.raises(ValueError):
        pack_histogram({300: 1}, 256)
