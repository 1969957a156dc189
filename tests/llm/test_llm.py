"""The text operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quarryline.llm import digest, hyperdim, lines, media, oddsketch, packing, pieces, ppm, queries, quotes, triecounts
from quarryline.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a  b", "   lead", "trail  ", "\n\n x", "日本語 😀😀 x", "▁a▁▁b", "<s> </s> <unk> <0x0A>", "\x00\x01 a", "a\tb \t c", "a" * 300, "<|endoftext|> hi", "\r\n \r\n", None]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows and columns with clashing names."""
    rows = [(i, t, "en", i) for i, t in enumerate(ODD)] + [(None, "null id", None, 1), (3, "   lead", "en", 3), (3, "   lead", "en", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_media_round_trip(odd):
    for r in media.text_images(odd).collect():
        if r.doc_id is not None and r.doc_id < len(ODD):
            text = (ODD[r.doc_id] or "").encode()
            payload = text + bytes((-len(text) % 64) or (0 if text else 64))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_image_formats():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode(media.encode_bmp(rgb)) == rgb).all()
    assert (media.decode(b"P6 7 5 255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P3\n# c\n7 5\n255\n" + " ".join(map(str, rgb.ravel())).encode()) == rgb).all()
    assert media.decode(b"P1\n3 1\n101")[..., 0].tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0")[..., 0].tolist() == [[0, 255, 0]]
    assert (media.from_npy(media.to_npy(rgb)) == rgb).all()
    with pytest.raises(ValueError):
        media.decode(b"P5 9 9 255\nxx")


def test_area_resize_is_the_mean():
    image = np.random.default_rng(2).integers(0, 256, (12, 18, 1)).astype(float)
    assert np.allclose(media.area_resize(image, 4, 6), image.reshape(4, 3, 6, 3, 1).mean(axis=(1, 3)))
    fine = media.area_resize(np.repeat(np.repeat(image, 5, 0), 7, 1), 5, 7)
    assert np.allclose(media.area_resize(image, 5, 7), fine)


def test_ppm_is_the_trie(spark):
    texts = ["the cat sat on the mat", "The dog sat", "", None, "cat the mat dog sat\nx", "zzz qqq", "é日本 the"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learn = [zlib.crc32(str(i).encode()) % 3 != 0 for i in range(len(texts))]
    want = ppm.brute_force([(t or "").encode() for t in texts], learn)
    got = {r.doc_id: r for r in ppm.held_out_scores(df, 3).collect()}
    for i, (n, known, total, base, score) in enumerate(want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, not learn[i])
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-4


def test_ppm_chances_sum_to_one():
    trie = ppm.AdaptiveTrie(3)
    trie.learn(b"abracadabra")
    assert abs(sum(10 ** trie.chance(b"bra", s) for s in range(256)) - 1) < 1e-9


def test_pieces_are_the_library_s(odd, docs):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for frame in (odd, docs):
        texts = {(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()}
        want = {(i, len(sp.encode(t or "")), hashlib.sha256(",".join(map(str, sp.encode(t or ""))).encode()).hexdigest(), hashlib.sha256(sp.decode(sp.encode(t or "")).encode()).hexdigest()) for i, t in texts}
        assert {tuple(r) for r in pieces.encode_documents(frame, path).collect()} == want


def test_random_pieces():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp, m, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.piece_model(path), random.Random(4)
    for _ in range(1000):
        t = "".join(rng.choice("ab  \n\t.eé日😀thin▁<0x>'s1") for _ in range(rng.randint(0, 30)))
        assert m.encode(t) == sp.encode(t) and m.decode(m.encode(t)) == sp.decode(sp.encode(t))


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\n\nWhat is a trie?"), (1, 1, "assistant", "A tree of prefixes."), (1, 2, "user", "On Monday X wrote:\n> what is   a TRIE?\nthat was mine"),
        (1, 3, "user", "> > What is a trie?\n> A tree of prefixes.\nthanks"), (1, 4, "user", ">that was mine\nok"), (2, 0, "user", "> A tree of prefixes.\nnew"), (3, 0, "user", None), (None, 0, "user", "> x"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [k[1] for k, r in sorted(got.items(), key=lambda x: x[1].position) if k[0] == 1] == [0, 2, 4, 1, 3]
    assert (got[1, 2].text, got[1, 2].to_turn, got[1, 4].root_turn, got[1, 4].depth) == ("that was mine", 0, 0, 2)
    assert (got[1, 3].deepest, got[1, 3].to_turn, got[2, 0].to_conv, got[2, 0].root_turn) == (2, 1, 1, 0)
    assert got[None, 0].text == "" and got[3, 0].text == ""


def brute_lines(rows, min_words):
    """Deleted line numbers by comparing every run with all earlier places."""
    cut = [(i, [u.strip(" \t\n\r\x0b\x0c") for u in re.split(r"(?<=\n)|(?<=[.!?]\s)|(?<=\s)(?=[A-ZÀ-Þ])", t)]) for i, t in sorted(rows)]
    out = {}
    for n, (i, own) in enumerate(cut):
        gone = set()
        for j, other in cut[: n + 1]:
            for off in range(-len(own), len(other)):
                if j == i and off >= 0:
                    continue
                run = []
                for k in range(len(own) + 1):
                    if k < len(own) and 0 <= k + off < len(other) and own[k] == other[k + off]:
                        run.append(k)
                        continue
                    if sum(len(own[x].split(" ")) if own[x] else 0 for x in run) >= min_words:
                        gone |= set(run)
                    run = []
        out[i] = len(gone)
    return out


def test_lines_against_all_places(spark):
    rng = random.Random(5)
    said = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rng.randint(3, 9))).capitalize() + "." for _ in range(300)]
    rows = []
    for i in range(25):
        own = [rng.choice(said) for _ in range(rng.randint(2, 12))]
        if i % 2:
            at = rng.randrange(len(own))
            own[at:at] = said[:12] if i % 4 == 1 else said[20:29]
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.removed_lines for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows, lines.MIN_WORDS)
    assert sum(got.values()) > 50


def brute_words(rows, n):
    """What is left of each text without the windows of n words that came before."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = t.split()
        gone = set()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if key in seen:
                gone |= set(range(k, k + n))
            seen.add(key)
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_lines_passages_anywhere(spark):
    rng, rows = random.Random(8), []
    words = [f"w{i}" for i in range(2000)]
    for i in range(40):
        plain, size = i % 2, rng.choice((40, 55, 60, 100, 150))
        passage = rng.choices(words, k=size)
        if not plain:
            passage = [x.capitalize() if rng.random() < 0.1 else x + "." if rng.random() < 0.1 else x for x in passage]
        for _ in range(2):
            rows.append((len(rows), "  " * (i % 3) + " ".join(rng.choices(words, k=rng.randint(5, 60)) + passage + rng.choices(words, k=rng.randint(5, 60)))))
    rows += [(500, "tick " * 90), (501, "a b c " * 30), (502, "tick " * 39)]
    got = {r.doc_id: r.text.split() for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_words(rows, lines.MIN_WORDS)
    assert got == {i: w for i, w in want.items() if w}
    assert sum(len(t.split()) for _, t in rows) - sum(map(len, want.values())) > 40 * 40


def test_lines_parts_elsewhere(spark):
    """The parts of a repeated passage each came before, in shorter contexts."""
    rng, rows = random.Random(9), []
    for i in range(20):
        part = [" ".join(rng.choices([f"w{k}" for k in range(500)], k=12)).capitalize() + "." for _ in range(7)]
        rows += [(len(rows) + j, " ".join(part[a:b])) for j, (a, b) in enumerate(((0, 3), (2, 5), (4, 7), (0, 7), (0, 7)))]
    got = {r.doc_id: r.removed_lines for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows, lines.MIN_WORDS)
    assert [got[i] for i in range(5)] == [0, 0, 0, 0, 7]


def test_lines_odd(odd):
    got = lines.dedup_lines(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    assert lines.dedup_lines(odd.limit(0)).count() == 0


def test_digest_order_and_bounds(spark, odd, docs):
    for frame in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"]), odd.where("doc_id = 2")):
        rows = sorted(((r.doc_id, r.text or "") for r in frame.collect()), reverse=True)
        got = {r.doc_id: r for r in digest.fingerprints(frame).collect()}
        assert len(got) == len(rows)
        for (i, t), (_, nxt) in zip(rows, [*rows[1:], rows[0]]):
            k = len(t) // 3
            edited = t[: len(t) - k] + nxt[:k]
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert got[i].fingerprint == digest.digest(t.encode()).hex() and got[i].near_next == digest.likeness(digest.digest(t.encode()), digest.digest(nxt.encode()))
            assert 0 <= got[i].near_edited <= 1
    assert digest.fingerprints(odd).count() == odd.count()
    assert digest.fingerprints(odd.limit(0)).count() == 0


def test_language_held_out(odd, docs):
    got = {r.doc_id: r for r in hyperdim.identify(docs).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert {r.lang_pred for r in hyperdim.identify(odd).collect() if r.doc_id in (0, 1, 14)} == {"und"}


def test_packing_is_whole(odd, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for frame in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in frame.collect()}
        rows = packing.pack(frame, path).collect()
        for i, want in ids.items():
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
            assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]])) and sum(r.length for r in own) == len(want) == own[0].doc_tokens
            assert all(zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in own)
        fill = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert fill.get(r.sequence_id, 0) == r.offset
            fill[r.sequence_id] = r.offset + r.length
        assert all(n == 2048 or n & (n - 1) == 0 for n in fill.values())


def test_packer_minimises_squares():
    rng, p = random.Random(6), packing.LevelPacker(16)
    for _ in range(300):
        n, count = rng.randint(1, 15), p.count.copy()
        costs = {}
        for h in range(0, 16 - n + 1):
            if h == 0 or count[h]:
                c = count.copy()
                c[h] -= h > 0
                c[h + n] += h + n < 16
                costs[h] = (c**2).sum()
        assert costs[p.place(n, n)] == min(costs.values())


def brute_near(rows, k=2):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates_are_exact(spark):
    rng, rows = random.Random(3), []
    words = [f"w{i}" for i in range(300)]
    for _ in range(3):
        base = [rng.choice(words) for _ in range(100)]
        for _ in range(40):
            t = list(base)
            for _ in range(rng.randint(0, 9)):
                t[rng.randrange(100)] = rng.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(t)))
    rows += [(5000, ""), (5001, None), (5002, "one"), (5003, "ONE"), (5004, "one two"), (5005, "  ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_odd(odd):
    got = oddsketch.near_duplicates(odd)
    assert got.count() == odd.count()
    assert {r.component_id for r in got.collect() if r.doc_id == 3} == {3}
    assert oddsketch.near_duplicates(odd.limit(0)).count() == 0


def test_trie_counts(odd, docs):
    scores = triecounts.unigram_scores(tokenizer_path("piece_bpe_32k.model"))
    unknown = min(scores.values()) - 10

    def best(word):
        at = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            options = [(at[i][0] + scores[word[i:j]], at[i][1] + 1, -i) for i in range(j) if word[i:j] in scores] + [(at[-1][0] + unknown, at[-1][1] + 1, -j)]
            top = max(o[0] for o in options)
            at.append(next(o[:2] for o in sorted(options, key=lambda o: o[2], reverse=True) if o[0] == top))
        return at[-1]

    texts = {r.doc_id: r.text or "" for r in odd.union(docs.where("doc_id > 100").select("doc_id", "text", "lang", "n_chars")).collect()}
    for r in triecounts.count_tokens(odd.union(docs.where("doc_id > 100").select("doc_id", "text", "lang", "n_chars")), tokenizer_path("piece_bpe_32k.model")).collect():
        words = texts[r.doc_id].encode().split()
        each = [best("▁" + w.decode()) for w in words]
        assert r.n_pretokens == len(words) and abs(r.best_score - sum(x[0] for x in each)) < 1e-6


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    for f in (media.text_images, ppm.held_out_scores, hyperdim.identify, lambda d: packing.pack(d, tokenizer_path("byte_bpe_50k.json"))):
        assert f(none).count() == 0


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 2048 and out.doc_id.nunique() > 100


def test_pipeline_language_rejects_junk(spark, docs):
    import base64

    import corpus_pipeline

    rng, junk = random.Random(11), []
    for _ in range(25):
        junk.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(400)))
        junk.append(base64.b64encode(rng.randbytes(300)).decode())
        junk.append(" ".join("".join(rng.choice("абвгдежзиклмнопрстуфхцчшщыьэюя") for _ in range(rng.randint(2, 9))) for _ in range(60)))
        junk.append("".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(300)))
        junk.append(rng.randbytes(300).hex())
    real = docs.select("doc_id", "text", "lang")
    short = real.where("length(text) > 400").selectExpr("doc_id + 200000 as doc_id", "substring_index(text, ' ', 6) as text", "cast(null as string) as lang")
    planted = spark.createDataFrame([(100000 + i, t, None) for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, real.union(planted).union(short), SF).collect()}
    assert sum(100000 <= i < 200000 for i in kept) <= 0.02 * len(junk)
    assert sum(i < 100000 for i in kept) >= 0.99 * real.count() and sum(i >= 200000 for i in kept) >= 0.95 * short.count()
