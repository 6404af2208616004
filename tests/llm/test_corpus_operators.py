"""Each operator against a brute-force version, and on odd rows."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vertexflow.llm import decontaminate, language, licenses, line_dedup, near_dup, packing, quality, queries, token_counts, token_files, topk

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, None, "en"), (2, "", None), (3, " ", "en"), (4, "a  b\n\n c \n", "fr"), (5, "one <|endoftext|> two\x00three  <|endoftext|>", "en"),
    (6, "ÀÉ ﬁ Å ό ́x\x1cy\x85z 12 345, don't. it's", "de"), (7, "word " * 5000, "en"), (7, "word " * 5000, "en"), (None, "null id text here", None), (9, "MIT License! mit  license", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, and columns with the names that operators use inside."""
    extra = ["id", "bucket", "words", "n", "label", "line", "place", "hit", "ids", "_doc", "x", "salt"]
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return rows.withColumns({c: F.lit("clash") for c in extra})


def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("which", ["small", "odd"])
def test_token_counts(spark, small, odd, which):
    docs = odd if which == "odd" else documents(spark, small)
    t = Tokenizer.from_file(BYTE)
    want = Counter((k, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 1024) for k, x in texts(docs))
    assert rows(token_counts.count_tokens(docs, BYTE), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_whole_tokens_are_proved():
    t, whole = Tokenizer.from_file(BYTE), sorted(token_counts.whole_tokens(BYTE))
    assert len(whole) > 40_000
    assert all(len(e.ids) == 1 for e in t.encode_batch(whole, add_special_tokens=False))


@pytest.mark.parametrize("which", ["small", "odd"])
def test_token_files_round_trip(spark, small, odd, tmp_path, which):
    docs = odd if which == "odd" else documents(spark, small)
    t = Tokenizer.from_file(BYTE)
    token_files.write_token_files(spark, docs, BYTE, str(tmp_path / "f"))
    got = sorted(token_files.read_token_files(spark, str(tmp_path / "f")).collect(), key=lambda r: r["start"])
    ids = sorted(((k is not None, k or 0), np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4").tobytes()) for k, x in texts(docs))
    start = 0
    assert len(got) == len(ids)
    for r, ((known, k), x) in zip(got, ids):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (k if known else None, start, len(x) // 4, zlib.crc32(x), x)
        start += len(x) // 4


def test_variable_length_coding():
    v = np.random.default_rng(1).integers(0, 2**32, 1001, dtype=np.uint64).astype(np.uint32) >> np.random.default_rng(2).integers(0, 32, 1001).astype(np.uint32)
    for n in (0, 1, 3, 4, 1001):
        control, data = token_files.pack_values(v[:n])
        assert len(control) == -(-n // 4) and (token_files.unpack_values(control, data, n) == v[:n]).all()


@pytest.mark.parametrize("which", ["small", "odd"])
def test_packing(spark, small, odd, which):
    docs = odd if which == "odd" else documents(spark, small)
    t, want = Tokenizer.from_file(WORD), Counter()
    for k, x in texts(docs):
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4")
        want.update((k, i, at, len(p := ids[at : at + 2048]), zlib.crc32(p.tobytes())) for i, at in enumerate(range(0, len(ids), 2048)))
    out = packing.pack(spark, docs, WORD).cache()
    assert rows(out, "doc_id", "piece", "start", "length", "ids_crc32") == want
    by = {}
    for r in out.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots in by.values():
        slots.sort()
        assert slots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(slots, slots[1:])) and sum(n for _, n in slots) <= 2048
    assert len(by) <= 1.05 * -(-sum(k[3] * n for k, n in want.items()) // 2048) + 1


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 3000).tolist()
    plan = packing.plan_best_fit(dict(Counter(lengths)), 100)
    space = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, s in enumerate(space) if s >= x]
        if fits:
            space[min(fits, key=space.__getitem__)] -= x
        else:
            space.append(100 - x)
    assert max(f + n for _, _, n, f, _ in plan) == len(space)
    assert Counter(x for x, _, n, *_ in plan for _ in range(n)) == Counter(lengths)


def brute_components(docs, k, percent):
    sets = {}
    for key, x in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", x.encode().translate(near_dup._LOWER))
        sets[key] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    up = {key: key for key in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    keys = [key for key in sorted(sets) if sets[key]]
    index = {}
    for key in keys:
        for other in {o for s in sets[key] for o in index.get(s, ())}:
            both = len(sets[key] & sets[other])
            if 100 * both >= percent * (len(sets[key]) + len(sets[other]) - both):
                a, b = root(key), root(other)
                up[max(a, b)] = min(a, b)
        for s in sets[key]:
            index.setdefault(s, []).append(key)
    return {key: (len(sets[key]), root(key), root(key) == key) for key in sets}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, small, k, percent):
    base = documents(spark, small).select("doc_id", "text")
    rng, more = np.random.default_rng(5), []
    for key, x in texts(base)[:25]:  # chains of edits
        words = x.split(" ")
        for step in range(6):
            words = list(words)
            words[rng.integers(len(words))] = f"edit{step}"
            more.append((1000 + 10 * len(more), " ".join(words)))
    docs = base.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(spark, docs, k, percent).collect()}
    assert got == brute_components(texts(docs), k, percent)


def test_near_duplicates_of_odd_rows(spark, odd):
    got = rows(near_dup.near_duplicates(spark, odd, 3, 85), "doc_id", "component_id", "kept")
    assert got == Counter([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True), (7, 7, True), (None, None, True), (9, 9, True)])


def test_near_duplicates_of_a_repeated_id_with_other_texts(spark):
    long, short = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 102), ("b", 32)))
    docs = spark.createDataFrame([(1, long), (1, short), (2, short + " more")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(spark, docs, 3, 85).collect()} == {(1, 1), (2, 1)}


def test_each_row_of_a_repeated_id_has_its_own_size(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "x y z"), (None, "p q r"), (None, "p q r s t u v w"), (2, "A b c  d e"), (3, "")], "doc_id long, text string")
    got = rows(near_dup.near_duplicates(spark, docs, 3, 85), "doc_id", "n_shingles", "component_id", "kept")
    assert got == Counter([(1, 3, 1, True), (1, 1, 1, True), (None, 1, None, True), (None, 6, None, True), (2, 3, 1, False), (3, 0, 3, True)])


def test_super_minhash_estimates_and_stops_exactly():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 400).astype(np.uint64), rng.integers(0, 2**63, 100).astype(np.uint64)
    both = [a, np.concatenate([a[:300], b])]
    sizes = np.array([400, 400, 1])
    h = near_dup.super_minhash(np.concatenate([*both, b[:1]]), sizes, 100)
    assert abs((h[0] == h[1]).mean() - 0.6) < 0.13
    assert sorted(np.floor(h[2])) == list(range(100))  # one element takes every rank once
    alone = near_dup.super_minhash(both[0], sizes[:1], 100)
    assert (alone[0] == h[0]).all()


def brute_contaminated(docs, items):
    out = {}
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(i, split.findall(x.lower())) for i, x in items]
    for key, x in docs:
        w, found = split.findall(x.lower()), []
        for i, t in items:
            span = min(12, len(t))
            if len(t) >= 7 and any(sum(a == b for a, b in zip(w[p : p + span], t[q : q + span])) >= 0.8 * span for q in range(len(t) - span + 1) for p in range(len(w) - span + 1) if w[p] == t[q] or w[p + 1] == t[q + 1] or w[p + 2] == t[q + 2]):
                found.append(i)
        out[key] = sorted(found)
    return out


def test_decontamination(spark, small):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    base = [(k, x) for k, x in texts(documents(spark, small)) if len(x) < 1500][:60]
    planted = []
    for i, (key, x) in enumerate(bench[:20]):
        w = x.split()
        for p in range(3, len(w), 8):
            w[p] = "swapped"
        planted.append((5000 + i, f"some words before {' '.join(w)} and after"))
    docs = base + planted
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = decontaminate.contaminated(spark, frame, spark.createDataFrame([*bench, (None, "x"), (77, None), (78, "")], "item_id long, text string"))
    got = {r["doc_id"]: r["items"] or [] for r in out.collect()}
    assert got == brute_contaminated(docs, bench)
    assert all(got[k] for k, _ in planted)


def test_seeds_hit_every_allowed_substitution(spark):
    docs, bench = [], []
    for n in range(1, decontaminate.SPAN + 1):
        item = [f"i{n}w{k}" for k in range(n)]
        allowed = max(s for s in range(n) if n - s >= decontaminate.SHARE * n)
        bench.append((n, " ".join(item)))
        for s in range(allowed + 1):
            for at in itertools.combinations(range(n), s):
                text = ["other" if k in at else w for k, w in enumerate(item)]
                assert any(not {p + o for o in m} & set(at) for m in decontaminate.MASKS[n] for p in range(n - m[-1])), (n, at)
                docs.append((1000 * n + len(docs), " ".join(text)))
        docs.append((-n, " ".join(["other"] * (allowed + 1) + item[allowed + 1 :])))
    bench.append((100, " ".join(f"long{k}" for k in range(30))))
    docs += [(100_000, " ".join("x" if k in (22, 23) else f"long{k}" for k in range(18, 30))), (100_001, "none of them")]
    got = {r["doc_id"]: r["items"] for r in decontaminate.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    for k, _ in docs:
        assert got[k] == (None if k < 0 or k == 100_001 else [100] if k == 100_000 else [k // 1000]), k


def test_decontamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "word " * 12)], "item_id long, text string")
    got = rows(decontaminate.contaminated(spark, odd, bench), "doc_id", "contaminated")
    assert got == Counter((k, k == 7) for k, *_ in ODD)


def test_decontamination_of_long_texts_with_repeated_seeds(spark):
    """Hits without number: a text of 60,000 words repeats an item's first words, and one holds a long item's copy far inside."""
    long_item = [f"w{i % 50}" for i in range(3000)]
    far = ["w1 w2 w3 q"] * 15_000 + long_item[1500:1512] + ["end"]
    bench = [(1, "alpha beta gamma delta epsilon zeta"), (2, " ".join(long_item)), (1, "another text under one id with words of its own")]
    docs = [(1, "alpha beta gamma x y " * 12_000), (2, " ".join(far)), (3, "alpha beta gamma x y " * 12_000 + "alpha beta other delta epsilon zeta"), (None, "its words another text under one id with words of its own now")]
    got = decontaminate.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {r["doc_id"]: r["items"] for r in got.collect()} == {1: None, 2: [2], 3: [1], None: [1]}


def test_texts_without_letters_have_no_language():
    assert not any(map(language.has_letter, ["", "²½ Ⅷ ①", "12 _ 3", "¼⅓", "-"])) and all(map(language.has_letter, ["a", "² x", "ß", "漢", "٣ ب", "ª"]))


def test_licenses(spark, small, odd):
    for docs in (documents(spark, small), odd):
        want = Counter()
        for k, x in texts(docs):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
            at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
            want[(k, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({b for _, b in at})))] += 1
        out = licenses.scan_licenses(spark, docs)
        assert rows(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
        for r in out.collect():
            assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_templates(spark):
    docs = [(i, f"Some code. {notice.upper()} -- etc") for i, (_, _, notice) in enumerate(licenses.TEMPLATES)] + [(99, "the person is free to use this software")] * 40
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan_licenses(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[99] == [""]
    assert all(label in got[i] for i, (label, _, _) in enumerate(licenses.TEMPLATES))


@pytest.mark.parametrize("several", [2, 3])
def test_license_templates_of_one_file(spark, several):
    groups = list(itertools.combinations(licenses.TEMPLATES, several))
    docs = [(i, " -- ".join(f"some code {notice}" for _, _, notice in g)) for i, g in enumerate(groups)] + [(-1, "the person is free to use this software")] * 400
    got = {r["doc_id"]: (set(r["labels"].split(",")), r["score"]) for r in licenses.scan_licenses(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, g in enumerate(groups):
        assert {label for label, _, _ in g} <= got[i][0] and got[i][1] == 1.0, (g, got[i])


def brute_labels(docs):
    """Labels of the templates by trying every alignment of every template."""
    def split(x):
        return re.findall(licenses.SEPARATORS.replace("[", "[^").removesuffix("+") + "+", re.sub("[A-Z]", lambda m: m[0].lower(), x))

    files = [(k, split(x)) for k, x in docs]
    seen = Counter(w for _, f in files for w in set(f))
    out = {}
    for k, f in files:
        labels = set()
        for label, phrase, notice in licenses.TEMPLATES:
            t, p = notice.split(), phrase.split()
            rare = sorted(set(t), key=lambda w: (-np.log((len(docs) + 1) / (seen[w] + 1)), w))[: licenses.RARE]
            best = max((len({w for i, w in enumerate(t) if w in rare and 0 <= i + shift < len(f) and f[i + shift] == w}) for shift in range(-len(t), len(f))), default=0)
            if best >= licenses.AGREE * len(rare) and any(f[i : i + len(p)] == p for i in range(len(f))):
                labels.add(label)
        out[k] = labels
    return out


def test_license_labels_against_every_alignment(spark, small):
    rng = np.random.default_rng(3)
    docs = [(k, x) for k, x in texts(documents(spark, small)) if len(x) < 3000][:60]
    for i in range(80):  # notices with dropped and swapped words, phrases alone, notices without them
        label, phrase, notice = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
        words = [w if rng.random() > 0.05 * (i % 9) else "other" for w in notice.split()]
        docs.append((10_000 + i, " ".join(["the code"] * (i % 3) + words + (phrase.split() if i % 2 else []))))
    got = {r["doc_id"]: (set(r["labels"].split(",")) - {""}) - (set(r["base_labels"].split(",")) - {""}) for r in licenses.scan_licenses(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute_labels(docs)
    base = {r["doc_id"]: set(r["base_labels"].split(",")) for r in licenses.scan_licenses(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: v - base[k] for k, v in want.items()}
    assert sum(map(bool, want.values())) > 30


def brute_lines(docs):
    def norm(x):
        return re.sub(r"\s+", " ", x.lower()).strip(" ")

    def shingles(x):
        return {x[i : i + 9] for i in range(len(x) - 8)} if len(x) >= 9 else {x}

    lines = [(k, p, norm(x)) for k, t in sorted(docs) for p, x in enumerate(t.split("\n")) if norm(x)]
    sets, up = [shingles(x) for *_, x in lines], list(range(len(lines)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, s in enumerate(sets):
        for j in range(i):
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    drop = {lines[i][:2] for i in range(len(lines)) if root(i) != i}
    return {k: "\n".join(x for p, x in enumerate(t.split("\n")) if (k, p) not in drop) for k, t in docs}


def test_line_dedup(spark, small):
    docs = texts(documents(spark, small))[:25]
    extra = []
    for k, t in docs[:12]:
        lines = t.split("\n")
        long = max(lines, key=len)
        extra.append((k + 500, f"Fresh {k}\n{long[:-1]}\n\n{long.upper()}!\n{'x' * (k % 4)}"))
    docs = docs + extra
    out = line_dedup.drop_repeated_lines(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    got, want = {r["doc_id"]: r["text"] for r in out.collect()}, brute_lines(docs)
    same = sum(got[k] == want[k] for k in want)
    assert set(got) == set(want) and same >= 0.97 * len(want)  # banding misses a few pairs near the threshold
    assert all(len(got[k]) >= len(want[k]) for k in want)


def test_line_dedup_recall_by_length(spark):
    rng, docs, of = np.random.default_rng(8), [], {}
    for kind in ("abcdefghij ", "".join(map(chr, range(0x4E00, 0x4E40)))):
        for n in (1, 2, 4, 5, 6, 9, 10, 15, 20, 26, 32, 33, 40, 41, 60, 100, 200, 400):  # shingles of the longer line
            for _ in range(30):
                line = "z" + "".join(rng.choice(list(kind), n + 6)).replace("  ", "ab").replace("  ", "ab") + "z"
                cut = n // 5  # a Jaccard similarity of 0.8 or just above
                key = len(docs)
                docs += [(key, line[: len(line) - cut].rstrip() if cut else line), (key + 1, line if cut else line.upper() + " ")]
                of[key + 1] = n
    docs += [(90_000, "subscribe to newsletter"), (90_001, "subscribe to newsletter!")]
    a = len(docs)
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_repeated_lines(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute_lines_of_pairs(docs)
    assert got[90_001] == 1 and len(got) == a
    for n in sorted(set(of.values())):
        keys = [k for k, m in of.items() if m == n and want[k]]
        share = sum(got[k] for k in keys) / len(keys)
        assert len(keys) >= 20 and (share == 1 if n <= line_dedup.FEW else share >= 0.95), (n, share, len(keys))


def test_bands_borrow_the_next_slot_in_compiled_code(spark, capsys):
    """Java only interprets methods of more than 8,000 bytes."""
    n, rows_of, rng = line_dedup.BANDS * line_dedup.ROWS, line_dedup.ROWS, np.random.default_rng(3)
    rows = [[None if rng.random() < share else int(rng.integers(1 << 31)) for _ in range(n)] for share in (0, 0.1, 0.5, 0.9) * 5] + [[None] * n]
    whole = [[next((r[(k + i) % n] for i in range(n) if r[(k + i) % n] is not None), None) for k in range(n)] for r in rows]
    names = ", ".join(f"v{k} long" for k in range(n))
    got = {r["id"]: (r["filled"], r["bands"]) for r in line_dedup._bands(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id long, {names}")).collect()}
    bands = F.array(*(F.xxhash64(F.lit(b), *(f"v{k}" for k in range(b * rows_of, (b + 1) * rows_of))) for b in range(line_dedup.BANDS)))
    want = {r["id"]: r["bands"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(whole)], f"id long, {names}").select("id", bands.alias("bands")).collect()}
    assert got == {i: (sum(x is not None for x in r), want[i]) for i, r in enumerate(rows)}
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        line_dedup._bands(line_dedup._slots(spark.createDataFrame([(1, "abc")], "id long, norm string"), True)).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000, sizes


def test_positions_are_64_bit_numbers_where_they_fit(spark):
    top = line_dedup._PLACES - 1
    for docs, narrow in (((-(1 << 32), -1, 0, 7, (1 << 32) - 1), True), ((0, 1 << 32), False), ((-(1 << 32) - 1, 0), False), ((5, (1 << 63) - 1), False)):
        lines = spark.createDataFrame([(d, p) for d in docs for p in (0, 1, top)], "doc long, place int")
        assert line_dedup._narrow(lines) == narrow
        rows = lines.select("doc", "place", line_dedup._position("doc", "place", narrow).alias("position")).collect()
        assert all(int(r["position"]) == r["doc"] * line_dedup._PLACES + r["place"] for r in rows)
    assert line_dedup._narrow(lines.limit(0))


def test_lines_are_signed_again_once(spark, monkeypatch):
    """Of equal lines that the cut leaves without a signature one is signed again; characters of two UTF-16 units count as one in a shingle."""
    signed, slots = [], line_dedup._slots
    monkeypatch.setattr(line_dedup, "_slots", lambda lines, cut: (signed.append((cut, lines.count())), slots(lines, cut))[1])
    docs = [(k, "ab" * 300) for k in range(1, 21)] + [(30, "ab" * 301)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_repeated_lines(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: int(k != 1) for k, _ in docs} and [n for cut, n in signed if not cut] == [2], (got, signed)
    rng = np.random.default_rng(5)
    wide = ["".join(rng.choice(list("abcdefgh\U0001f600\U00010437é漢"), n)) for n in (1, 8, 9, 10, 71, 72, 73, 200)] + ["plain text", "é" * 12]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(wide)], "id long, norm string").select("id", line_dedup._shingles("norm").alias("e")).collect()
    hashes = {}
    for r in rows:
        x = wide[r["id"]]
        pieces = [x[i : i + 9] for i in range(max(len(x) - 8, 1))]
        assert len(r["e"]) == len(pieces), x
        for piece, e in zip(pieces, r["e"]):
            assert hashes.setdefault(piece, e) == e
    assert len(set(hashes.values())) == len(hashes)


def brute_lines_of_pairs(docs):
    """Whether the second of two documents, of one line each, is similar to the first."""
    sets = [{x[i : i + 9] for i in range(max(1, len(x) - 8))} for x in (" ".join(t.lower().split()) for _, t in docs)]
    return {docs[i + 1][0]: 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1]) for i in range(0, len(docs), 2)}


def test_line_dedup_of_odd_rows(spark, odd):
    got = Counter((r["doc_id"], r["text"], r["n_dropped"], r["bucket"]) for r in line_dedup.drop_repeated_lines(spark, odd).collect())
    assert got == Counter((k, t, 0, "clash") for k, t, _ in ODD)


def test_top_k(spark, small):
    v = spark.read.parquet(f"{small}/embeddings.parquet")
    bad = spark.createDataFrame([(100_000, None), (100_050, [None] * 64), (None, [0.1] * 64), (100_100, [float("nan")] * 64), (100_150, [float("inf")] * 64), (100_200, []), (50, None)], "vec_id long, embedding array<float>")
    ties = v.limit(30).withColumn("vec_id", F.col("vec_id") + 50_001)
    every = v.select("vec_id", "embedding").unionByName(ties.select("vec_id", "embedding")).unionByName(bad)
    data = [(r["vec_id"], np.floor(256 * np.array(r["embedding"], np.float64))) for r in every.where("vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))").collect()]
    want = Counter()
    for q, x in data:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in data if i != q)[:5]
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    for block in (4096, 4):
        out = topk.top_k(spark, every, F.col("vec_id") % 50 == 0, 5, query_block=block)
        assert rows(out, "query_id", "rank", "vec_id", "score") == want


def test_top_k_of_repeated_query_ids(spark):
    rng = np.random.default_rng(4)
    data = [(i % 60, rng.normal(size=8).round(2)) for i in range(150)]
    data += [(50, data[0][1]), (0, data[0][1])]  # a repeated row is one query
    floors = [(i, np.floor(256 * v)) for i, v in data]
    want = Counter()
    for q in (0, 50):
        mine = {tuple(v) for i, v in floors if i == q}
        best = sorted((-int(np.array(x) @ y), i) for x in mine for i, y in floors if i != q)[:5]
        want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in data], "vec_id long, embedding array<double>")
    for block in (4096, 2):
        assert rows(topk.top_k(spark, vectors, F.col("vec_id") % 50 == 0, 5, query_block=block), "query_id", "rank", "vec_id", "score") == want


def test_top_k_resolves_few_scores():
    rng = np.random.default_rng(6)
    q, x = np.floor(256 * rng.normal(size=(40, 64))), np.floor(256 * rng.normal(size=(2000, 64)))
    own = np.zeros((40, 2000), bool)
    own[:, 0] = True
    qi, ri = topk.gathered(q, x, own, 5, topk.LISTS)
    low = topk.resolved(q, x, qi, ri)
    cut = np.array([np.sort(low[qi == i])[-5] for i in range(40)], float)
    qj, rj = topk.collected(q, x, own, cut, topk.LISTS)
    score = topk.resolved(q, x, qj, rj)
    whole = q @ x.T
    for i in range(40):
        assert sorted(score[(qj == i) & (score >= cut[i])])[-5:] == sorted(whole[i, 1:])[-5:]
    assert len(qi) <= 40 * 5 * topk.LISTS and len(qj) < 0.3 * whole.size


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language.ByteGru(["a", "b", "c"], 4, 1)
    net.w = {k: v.astype(np.float64) * 0.7 for k, v in net.w.items()}
    windows, labels = rng.integers(1, 255, (5, 9)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    windows[2, 5:] = 0
    net.w["x"][:, 0] = 0

    def loss():
        p, _ = net.probabilities(windows)
        mask = windows.T != 0
        return -(np.log(p[:, np.arange(5), labels]) * mask).sum() / mask.sum()

    g = net.gradients(windows, labels)
    for k in ("u", "v", "c", "x"):
        at = (0, int(windows[0, 0]), 3) if k == "x" else tuple(0 for _ in net.w[k].shape)
        old, eps = net.w[k][at], 1e-3
        net.w[k][at] = old + eps
        up = loss()
        net.w[k][at] = old - eps
        down = loss()
        net.w[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-3


def test_language_held_out(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op6_language(spark, sf).join(docs, "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.97
    net = language.train(odd, F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(spark, odd, net).collect()}
    assert [got[k] for k in (1, 2, 3)] == ["und"] * 3 and got[7] != "und"
    assert language.train(odd.limit(0), F.lit(True)) is None


def test_fast_labels_are_the_network_s():
    rng = np.random.default_rng(9)
    net = language.ByteGru(["a", "b", "c"])
    texts_ = [bytes(rng.integers(1, 256, n).tolist()) for n in (1, 63, 64, 65, 200)] + [b"x\0y"]
    got = net.pooled(texts_)
    for t, p in zip(texts_, got):
        rows_ = -(-len(t) // language.WINDOW)
        w = np.frombuffer(t.ljust(rows_ * language.WINDOW, b"\0"), np.uint8).reshape(-1, language.WINDOW)
        each = net.probabilities(w)[0].transpose(1, 0, 2)
        total = (each * (w != 0)[..., None]).sum((0, 1))
        assert np.allclose(p, total / total.sum(), atol=1e-5)


def test_quality_against_brute_force(spark, small, odd, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10**9).alias("doc_id"), "text"))
    docs = docs.unionByName(spark.createDataFrame([(2 * 10**9, "long words here " * 100_000)], docs.schema))
    docs.withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{small}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = rows(queries.op1_quality(spark, str(tmp_path)).withColumn("score", F.round("score", 6)), "doc_id", "held_out", "score", "predicted")
    held = {k: k is not None and zlib.crc32(str(k).encode()) % 5 == 0 for k, _ in texts(docs)}
    data = texts(docs)
    x = dict(zip([k for k, _ in data], quality.statistics([t for _, t in data])))
    known = [(x[r["doc_id"]], r["quality"]) for r in labels.collect() if r["quality"] is not None and not held.get(r["doc_id"], True)]
    by = [np.array([v for v, y in known if y == k]) for k in (0, 1)]
    cov = [np.cov(b.T, bias=True) for b in by]
    every = sum(c * len(b) for c, b in zip(cov, by)) / len(known)
    spread = np.diag(np.maximum(np.diag(every), 1e-6))
    cov = [(1 - quality.POOLED - quality.DIAGONAL) * c + quality.POOLED * every + quality.DIAGONAL * spread + 1e-6 * np.eye(len(c)) for c in cov]
    want = Counter()
    for (k, _), v in zip(data, quality.statistics([t for _, t in data])):
        dense = [np.log(len(b) / len(known)) - 0.5 * (np.linalg.slogdet(c)[1] + (v - b.mean(0)) @ np.linalg.solve(c, v - b.mean(0))) for b, c in zip(by, cov)]
        s = 1 / (1 + np.exp(np.clip(dense[0] - dense[1], -500, 500)))
        want[(k, held[k], round(float(s), 6), int(s >= 0.3))] += 1
    off = sum((got - want).values())
    assert off <= 2 and len(got) == len(want)  # a score may round the other way


def test_quality_held_out(spark, odd):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = [(r["quality"], r["score"], r["predicted"]) for r in queries.op1_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()]
    good, bad = [s for y, s, _ in got if y], [s for y, s, _ in got if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([p for y, _, p in got if y]) > 0.97
    scores = quality.score_quality(spark, odd, labels.limit(0), F.lit(True))
    assert rows(scores, "doc_id", "score") == Counter((k, 0.5) for k, *_ in ODD)


def test_discriminant_is_a_gaussian_log_density():
    rng = np.random.default_rng(0)
    x = [rng.normal(m, s, (500, 3)) for m, s in ((0, 1), (1, 2))]
    n = np.array([500.0, 500.0])
    d = quality.Discriminant.fit(n, np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]), 0, 0)
    p = rng.normal(0, 2, (10, 3))
    dense = []
    for a in x:
        c, m = np.cov(a.T, bias=True) + 1e-6 * np.eye(3), a.mean(0)
        dense.append(-0.5 * (np.linalg.slogdet(c)[1] + np.einsum("ij,jk,ik->i", p - m, np.linalg.inv(c), p - m)))
    assert np.allclose(d.score(p), 1 / (1 + np.exp(dense[0] - dense[1])))


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (
        token_counts.count_tokens(none, BYTE), packing.pack(spark, none, WORD), near_dup.near_duplicates(spark, none), decontaminate.contaminated(spark, none, bench), licenses.scan_licenses(spark, none),
        line_dedup.drop_repeated_lines(spark, none), topk.top_k(spark, spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0), language.predict(spark, none, None),
    ):
        assert out.count() == 0
    assert not rows(decontaminate.contaminated(spark, odd, bench).where("contaminated"), "doc_id")


def test_empty_token_files(spark, odd, tmp_path):
    token_files.write_token_files(spark, odd.limit(0), BYTE, str(tmp_path / "f"))
    assert token_files.read_token_files(spark, str(tmp_path / "f")).count() == 0


def test_odd_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, n, replace=False), rng.integers(0, 2**63, m, dtype=np.uint64)])) for n, m in [(400, 0), (390, 5), (200, 40), (1, 0), (0, 0), (400, 3000)]]
    sketches = near_dup.odd_sketches(sets).view(np.uint64)
    for a, x in zip(sets, sketches):
        for b, y in zip(sets, sketches):
            apart = sum(int(v).bit_count() for v in x ^ y)
            assert apart <= len(np.setxor1d(a, b)) and (apart - len(np.setxor1d(a, b))) % 2 == 0


def test_near_duplicates_against_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = Counter(con.execute(queries.ORACLE_SQL["op9_near_dup"]).fetchall())
    assert rows(queries.op9_near_dup(spark, small), "doc_id", "n_shingles", "component_id", "kept") == want
