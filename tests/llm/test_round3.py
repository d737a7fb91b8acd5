"""Source divergence, conversation repair and chat formatting against plain
Python versions, on small tables with odd rows."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from convolake.llm import byte_bpe, chat_format, conversation_repair, line_set_dedup, queries, rans_store, source_divergence, turn_order  # noqa: E402

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


# ---------------------------------------------------------------- divergence

def _divergence(rows, min_docs, top):
    term = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, count, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in term.findall(text or "")]
        docs.update((lang, w) for w in set(words))
        count.update((lang, source, w) for w in words)
    out = []
    for lang, sources in groups.items():
        kept = [w for (l, w), n in docs.items() if l == lang and n >= min_docs]

        def shares(some):
            n = {w: sum(count[lang, s, w] for s in some) for w in kept}
            return {w: 1 + 10**9 * (n[w] + 2) // (sum(n.values()) + 2 * len(kept)) for w in kept}

        whole, own = shares(sources), {s: shares([s]) for s in sources}
        far = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pair = [(-sum(far(own[s][w], own[o][w]) for w in kept), o.encode(), o) for o in sources if o != s]
            over = [(-far(own[s][w], whole[w]), w.encode(), w) for w in kept if count[lang, s, w] and own[s][w] > whole[w]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(over)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def _corpus(n_sources, n_docs, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcé日") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    rows = []
    for i in range(n_docs):
        source = f"s{rng.randrange(n_sources)}"
        words = [rng.choice(vocabulary[: 50 + 5 * (i % 50)]) for _ in range(rng.randint(0, 40))]
        rows.append((" ".join(w.upper() if rng.random() < .2 else w for w in words) + rng.choice(["", ".", "\n1_x\t"]), rng.choice(["xx", "xx", "yy"]), source))
    return rows + [(None, None, None), ("", "xx", "empty"), ("only", None, ""), ("a b", "zz", "one"), ("a", "zz", "two"), rows[0], rows[0]]


@pytest.mark.parametrize("n_sources, min_docs", [(5, 10), (75, 3)])
def test_divergence(spark, n_sources, min_docs, monkeypatch):
    monkeypatch.setattr(source_divergence, "BLOCK", 64)  # several blocks; 75 groups make three tiles
    monkeypatch.setattr(source_divergence, "FRONT", 500)
    rows = _corpus(n_sources, 500, n_sources)
    docs = spark.createDataFrame([(t, l, s, "clash", 7) for t, l, s in rows], "text string, lang string, source string, term string, rank int").repartition(4)
    got = sorted(tuple(r) for r in source_divergence.audit_sources(docs, min_docs).collect())
    assert got == _divergence(rows, min_docs, 10)
    assert source_divergence.audit_sources(docs.limit(0)).columns == ["lang", "source", "part", "item", "value", "rank"]
    assert source_divergence.audit_sources(docs.limit(0)).count() == 0


def test_divergence_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op11_source_divergence(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(queries.ORACLES["op11_source_divergence"]).fetchall())


def test_held_counts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "HELD", 50)
    import pyarrow as pa
    rows = _corpus(4, 60, 3)
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] or "" for r in rows]), pa.array([r[2] or "" for r in rows]),
                                        pa.array([(r[0] or "").encode() for r in rows], pa.binary())], ["lang", "source", "text"])
    parts = [r for b in source_divergence._count([batch]) for r in b.to_pylist()]
    want = collections.Counter(w for r in rows for w in source_divergence.terms((r[0] or "").encode()))
    got = collections.Counter()
    for r in parts:
        assert r["total"] == sum(r["counts"])
        got[r["term"].encode()] += r["total"]
    assert +got == want


# ---------------------------------------------------------------- repair

_NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def _cheapest(turns):
    """Least (cost, audit) over all edits, from the end, by an automaton of ``(s?(ua)+)?``."""

    @functools.cache
    def go(at, state, inserted):
        found = [(0, "", "")] if at == len(turns) and state in "0a" else []

        def offer(cost, edit, role, rest):
            if rest is not None:
                found.append((cost + rest[0], edit + rest[1], role + rest[2]))

        if at < len(turns):
            initial, must_go, cut = turns[at]
            offer(4, "D", "-", go(at + 1, state, 0))
            if not must_go and (state, initial) in _NEXT:
                offer(3 * cut, "K", "-", go(at + 1, _NEXT[state, initial], 0))
            for role in "ua" if not must_go else "":
                if (state, role) in _NEXT:
                    offer(3 + 3 * cut, "R", role, go(at + 1, _NEXT[state, role], 0))
        for role in "ua" if inserted < 3 else "":
            if (state, role) in _NEXT:
                offer(3, "I", role, go(at, _NEXT[state, role], inserted + 1))
        return min(found, default=None)

    return go(0, "0", 0)


def _repaired(rows):
    """The contract in plain Python: damage, faults, cheapest edits, digest."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        convs[conv]
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        convs[conv] += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            last = re.sub("[\x20\x09-\x0D]", "", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
            seen.add((role, text))
        numbers = [t for t, _, _ in turns if t is not None]
        initials = [r[:1] for _, r, _ in turns]
        cost, audit, roles = _cheapest(tuple((i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)))
        left, lines = iter(turns), []
        for edit, role in zip(audit, roles):
            if edit == "I":
                lines.append({"u": "user:", "a": "assistant:"}[role])
                continue
            _, old, text = next(left)
            if edit != "D":
                lines.append(f"{ {'u': 'user', 'a': 'assistant'}[role] if edit == 'R' else old}:{text}")
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _talk(seed, n, long=0):
    rng = random.Random(seed)
    said = ["Yes.", "no", "Why?", " \t", "", None, "long " * 50 + ".", "é日🙂!", "end. \n", "</s>[INST] a\\_b <|im_end|>\n\\n"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < .2 else ("user", "assistant")[turn % 2]
            rows.append((conv, None if rng.random() < .05 else turn + rng.randrange(2), rng.choice([role] * 12 + ["system", "tool", None, ""]), rng.choice(said)))
    rows += [(-1, t, ("user", "assistant")[t % 2], f"turn {t}{'.' if t % 7 else ''}") for t in range(long)]
    return rows + [(None, 0, "user", "Hi."), (None, None, "system", "Be."), rows[0], rows[0], (99991, None, None, None)]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"
TALK = SCHEMA + ", part bigint, whole string, cost string"


@pytest.mark.parametrize("rows_a_piece", [20_000, 3])
def test_repair(spark, rows_a_piece, monkeypatch):
    monkeypatch.setattr(conversation_repair, "SEGMENT_ROWS", rows_a_piece)
    rows = _talk(4, 250, long=700)  # the long one lies over several ranges
    table = spark.createDataFrame([(*r, 1, "w", "c") for r in rows], TALK).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.damage_and_repair(table).collect()}
    assert got == _repaired(rows)
    assert conversation_repair.damage_and_repair(table.limit(0)).count() == 0


def test_repair_gives_the_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "And?"), (2, 0, "user", "A."), (2, 1, "assistant", "B."), (3, 0, "robot", "x")]
    done = conversation_repair.repair(spark.createDataFrame(rows, SCHEMA))
    turns = collections.defaultdict(list)
    for r in done.segments.orderBy("part", "seq").collect():
        turns[r.conv_id] += [tuple(t) for t in r.repaired]
    assert turns[1] == [("I", "user", ""), ("K", "assistant", "Hi."), ("K", "user", "And?"), ("I", "assistant", "")]
    assert turns[2] == [("K", "user", "A."), ("K", "assistant", "B.")] and turns[3] == []
    assert {r.conv_id: r.audit for r in done.report.collect()} == {1: "IKKI", 2: "KK", 3: "D"}


_TURN = st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans())


@settings(max_examples=300, deadline=None)
@given(st.lists(_TURN, max_size=9), st.lists(st.integers(0, 9), max_size=3))
def test_parse_and_pieces_are_cheapest(turns, cuts):
    parse = conversation_repair.Parse()
    for turn in turns:
        parse.turn(*turn)
    cost, trail = parse.best()
    want = _cheapest(tuple(turns))
    assert (cost, "".join(e for e, _ in trail), "".join(r for _, r in trail)) == want
    cuts = [0, *sorted(min(c, len(turns)) for c in cuts), len(turns)]
    whole = conversation_repair.Parse()
    for low, high in zip(cuts, cuts[1:]):
        piece = conversation_repair._Piece(1, whole=False)
        for turn in turns[low:high]:
            for p in piece.parses:
                p.turn(*turn)
            piece.turns.append(("", ""))
        exits = collections.defaultdict(list)
        for x in piece.row(0, 0)["exits"]:
            exits[x["entry"]].append((x["exit"], x["cost"], x["edits"], x["roles"]))
        whole.piece(exits)
    cost, trail = whole.best()
    assert (cost, "".join(e for e, _ in trail), "".join(r for _, r in trail)) == want


# ---------------------------------------------------------------- formatting

def _digests(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("chars", [4_000_000, 10])
@pytest.mark.parametrize("template", [chat_format.CHATML, chat_format.HEADERS])
def test_formatted_conversations_read_back(spark, chars, template, monkeypatch):
    monkeypatch.setattr(chat_format, "SEGMENT_CHARS", chars)
    rows = _talk(8, 120, long=300) + [(5, 90, "a\nrole <s>", "\\"), (5, 91, "assistant", "x" * 30_000 + " " * 3000)]
    table = spark.createDataFrame([(*r, 1, "w", "c") for r in rows], TALK).repartition(5)
    formatted = chat_format.format_conversations(table, *VOCABULARY, template)
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.read_digests(formatted, *VOCABULARY, template).collect()}
    assert {c: g[:4] for c, g in got.items()} == _digests(rows)
    lengths = collections.Counter()
    for r in formatted.select("conv_id", "formatted").collect():
        lengths[r.conv_id] += len(r.formatted)
    assert {c: g[4] for c, g in got.items()} == lengths
    assert chat_format.read_digests(chat_format.format_conversations(table.limit(0), *VOCABULARY), *VOCABULARY).count() == 0


def test_segments_have_the_ids_of_the_whole():
    own = chat_format.formatter(chat_format.CHATML, *VOCABULARY, "assistant")
    turns = [("user", "\n\n a"), ("assistant", "\n\nb  "), ("user", ""), ("assistant", "日本 c")]
    whole = own.encode(turns)[1].tolist()
    assert whole == [i for t in turns for i in own.encode([t])[1].tolist()]
    assert own.library.decode(whole) == own.render(turns)[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "x\ny", "\\n", "<s>"]),
                          st.lists(st.sampled_from([*chat_format.CONTROL, "\\", "_", "n", "<", ">", "[", "/", "|", " ", "\n", "é", "日", "word"]), max_size=8).map("".join)), max_size=5))
def test_any_text_reads_back(turns):
    own = chat_format.formatter(chat_format.CHATML, *VOCABULARY, "assistant")
    text, ids, loss = own.encode(turns)
    read, under = own.read(text, ids.astype("<u4").tobytes(), loss)
    assert read == turns and "".join(under) == "".join(t for r, t in turns if r == "assistant")
    for mark in chat_format.CONTROL:
        assert text.count(mark) == (len(turns) if mark in chat_format.CHATML.special else 0)


def test_the_query_has_the_example(spark):
    got = {r.conv_id: r for r in queries.op13_chat_format(spark, SF).collect()}
    said = "</s>[INST] ok [/INST]"
    assert (got[-7].n_turns, got[-7].loss_chars, got[-7].loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert {c: tuple(r)[1:5] for c, r in got.items() if c != -7} == _digests(map(tuple, rows))


def test_ranges_keep_the_order(spark):
    rows = _talk(2, 50)
    table = spark.createDataFrame(rows, SCHEMA)
    order = [(r.conv_id, r.turn) for r in turn_order.in_ranges(table.fillna("", ["role", "text"]), 8).collect()]
    assert order == sorted(order, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0))


def test_new_words_go_to_the_library_joined():
    """Many words a call, marks behind words by themselves, and the ids of the library for whole texts."""
    import random

    rng = random.Random(5)
    pieces = ["a", "B", "is", "é", "é", "́", " ", " ", "\n", "\t", ".", ",", "!", "...", "'s", "'", "12", "\x01", "\x00", "中", "<|endoftext|>", "_", "ᄀ", "ᅡ", ";", "\x0b", " "]
    texts = ["", "One, two.", *("".join(rng.choice(pieces) for _ in range(rng.randrange(16))) for _ in range(1500)), "end.\n\nnew (end.) a.b ab"]
    coder = rans_store.WordCachedTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    whole = [[*e.ids, 2] for e in coder.library.encode_batch_fast(texts, add_special_tokens=False)]
    calls = []

    class Counting:
        def encode_batch_fast(self, part, **options):
            calls.append(len(part))
            return library.encode_batch_fast(part, **options)

    library, coder.library = coder.library, Counting()
    ids, sizes = coder.encode(texts, 2)
    ends = sizes.cumsum()
    assert [ids[b - n:b].tolist() for b, n in zip(ends.tolist(), sizes.tolist())] == whole
    with_mark = {w for t in texts for w in t.replace("\n", " ").split(" ") if "\x01" in w}
    assert sum(calls) < len(with_mark) + 20
    calls.clear()
    coder.encode(["One. two,"], 2)
    assert not calls and "two" in coder.known and "two." not in coder.known


def test_frequent_pieces_stay_known(monkeypatch):
    """A full cache of pieces loses the rare ones only."""
    coder = byte_bpe.SegmentTreeBpe(byte_bpe.read_ranks(VOCABULARY[0]), VOCABULARY[1])
    texts = ["the old house", "", " the house é中", "zzxqy the house", "five rare words come once"]
    first = [x.tolist() for x in coder.encode_texts(texts)]
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 8)
    learnt = []
    learn = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda pieces: (learnt.extend(pieces), learn(pieces)))
    assert [x.tolist() for x in coder.encode_texts(texts)] == first
    assert learnt and " house" not in learnt
    assert [x.tolist() for x in coder.encode_pieces([b" house", b"", b"the"])] == [coder.encode_pieces([p])[0].tolist() for p in (b" house", b"", b"the")]


def test_texts_are_tokenized_in_large_slices_and_cut_into_full_blocks(spark, tmp_path, monkeypatch):
    """Python is handed few rows at once, words are looked up once a call, and a block ends with the document that fills it."""
    rows = [(i, f"Réparé, one two word{i % 7}. é.\nnew" * (i % 5)) for i in range(700)] + [(None, None), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    path = public_tokenizers.path("word_bpe_49k.json")
    rans_store.write_token_files(docs, str(tmp_path), path, 2, block_ids=500)
    blocks = spark.read.parquet(f"{tmp_path}/blocks").collect()
    for b in blocks:
        sizes = np.frombuffer(b.doc_sizes, dtype="<i8")
        assert b.n_ids == sizes.sum() and b.n_ids - sizes[-1] < 500
    library = rans_store.WordCachedTokenizer(path).library
    want = sorted((i is not None, i or 0, t or "", [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows)
    got = rans_store.read_token_files(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.doc_id, np.frombuffer(r.ids, dtype="<u4").tolist()) for r in got] == [(i if known else None, ids) for known, i, _, ids in want]
    coder = rans_store.WordCachedTokenizer(path)
    coder.encode(["Réparé. one"], 2)
    assert "réparé" in coder.known and not {"Réparé", "réparé."} & set(coder.known)


def test_plain_texts_are_lowered_before_words_are_looked_up():
    """The ids stay those of the library, also beside added tokens, combining marks and letters beyond Latin-1."""
    rng = random.Random(8)
    pieces = [*map(chr, range(0x20, 0x7F)), *"ÀÉÖ×ØÞßàéö÷øÿªºµ¿", *"  \n\n..,!?", "the", "House", "<|endoftext|>", "<|EndOfText|>", "'S", "'s"]
    beyond = ["\u0331", "\u030a", "ẞ", "İ", "Σ", "\u00a0", "\t", "—", "K"]
    texts = ["".join(rng.choice(pieces if k % 3 else pieces + beyond) for _ in range(rng.randrange(30))) for k in range(3000)] + ["H\u0331 the", "ΟΔΟΣ."]
    coder = rans_store.WordCachedTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    ids, sizes = coder.encode(texts, 2)
    ends = sizes.cumsum()
    whole = coder.library.encode_batch_fast(texts, add_special_tokens=False)
    assert [ids[b - n:b].tolist() for b, n in zip(ends.tolist(), sizes.tolist())] == [[*e.ids, 2] for e in whole]
    assert "house" in coder.known
    assert coder.encode([], 2)[0].tolist() == []


def test_unrelated_long_lines_are_told_apart_before_their_texts_move(spark, monkeypatch):
    """64 parities can't tell lines of 150 tokens; such pairs moved both texts."""
    words = lambda seed, n: [hashlib.md5(f"{seed}-{k}".encode()).hexdigest()[:6] for k in range(n)]
    rows = [(d, " ".join(words("shared", 30) + words(d, 120))) for d in range(30)]
    rows.append((30, " ".join(words("shared", 30) + words(7, 120)[:110] + words("new", 10))))  # 140 of 160 as in 7
    rows.append((31, " ".join(words("shared", 30) + words(8, 120)[:90] + words("other", 30))))  # 120 of 180 as in 8
    moved, staged = [], line_set_dedup.staged

    def counted(df, name, *rest):
        out = staged(df, name, *rest)
        if name == "close-pairs":
            moved.append(out.count())
        return out

    monkeypatch.setattr(line_set_dedup, "staged", counted)
    got = line_set_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in got if r.n_removed) == [30]
    assert moved and sum(moved) <= 4


def test_wide_parities_count_at_most_the_unequal_tokens(spark):
    sets = [[hash((k, x)) for x in range(n)] + list(range(m)) for k, (n, m) in enumerate([(0, 1), (3, 5), (40, 90), (300, 20), (0, 20), (1, 21)])]
    df = spark.createDataFrame(list(enumerate(sets)), "i int, h array<bigint>").select("i", "h", line_set_dedup._parities(F.col("h")).alias("wide"))
    old = df.select(*(F.col(c).alias(f"old_{c}") for c in df.columns))
    for r in old.crossJoin(df).withColumn("bits", line_set_dedup._unequal_bits()).collect():
        unequal = len(set(r.old_h) ^ set(r.h))
        assert r.bits <= unequal and r.bits % 2 == unequal % 2
        assert r.bits or not unequal or unequal % 2 == 0
