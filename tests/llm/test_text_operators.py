import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from pactspark.llm import line_dedup, mixing, multiset_hash, pieces, quality, simhash, token_counts  # noqa: E402

ODD_TEXTS = ["<|endoftext|> it's Ünï ΣΑΣ 'll<|startoftext|>", "<|ENDOFTEXT|>x", "a b c\x85d é 123 🎉🎉", "'s'S don'T <|endoftext|", "x" * 3000, "I'ſ kK ẞ İ", "áé    b", "word word word " * 300]


# op10


def metaspace(tmp_path):
    """The word tokenizer behind another splitter, which marks the blanks of each text."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.normalizer = normalizers.Lowercase()
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Metaspace(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tok.save(str(tmp_path / "m.json"))
    return str(tmp_path / "m.json")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", metaspace])
def test_token_counts(spark, documents, name, tmp_path):
    from tokenizers import Tokenizer

    path = name(tmp_path) if callable(name) else public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    docs = documents.select("doc_id", "text").union(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(ODD_TEXTS)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r for r in token_counts.count_tokens(docs, path, limit=300).collect()}
    assert found.keys() == texts.keys()
    for k, t in texts.items():
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (found[k].n_tokens, found[k].n_bytes, found[k].over_limit) == (n, len(t.encode()), n > 300)


def test_other_tokenizers_are_refused(tmp_path, monkeypatch):
    from tokenizers import AddedToken, Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.add_special_tokens([AddedToken("<x>", lstrip=True)])
    with pytest.raises(ValueError):
        token_counts.PreTokens(tok)
    words = token_counts.PreTokens(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    assert words.by_word and not token_counts.PreTokens(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))).by_word
    monkeypatch.setattr(token_counts, "MOST_PIECES", 2)
    count = token_counts.piece_counter(words.tok)
    assert [count("P" + w) for w in ("tion", "xqzw", "tion", "a", "xqzw")] == [len(words.tok.model.tokenize(w)) for w in ("tion", "xqzw", "tion", "a", "xqzw")] and count("S<|endoftext|>") == 1


def test_token_counts_of_messy_rows(messy):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(messy, path).collect()]
    assert sorted(rows, key=str)[:4] == [(1, 2), (1, 3), (1, 3), (2, 0)] and len(rows) == 9 and (None, 0) in rows and (None, 2) in rows
    assert token_counts.count_tokens(messy.limit(0), path).collect() == []


# op9


def test_multiset_hash_is_homomorphic():
    h = multiset_hash.Hasher()
    a, b = h.paragraph("one two three four"), h.paragraph("five six")
    both = multiset_hash.add(a, b)
    assert np.array_equal(both, h.text("five six\none two three four")) and np.array_equal(multiset_hash.remove(both, b), a)
    assert np.array_equal(multiset_hash.remove(both, both), multiset_hash.empty())
    assert multiset_hash.digest(h.text("x\ny\nx")) != multiset_hash.digest(h.text("x\ny"))
    assert multiset_hash.likeness(a, a) == 1.0 and multiset_hash.likeness(a, b) < 0.2


def shingles_of(text):
    """Brute force: how many paragraphs hold each shingle."""
    out = defaultdict(int)
    for p in text.split("\n"):
        w = p.split()
        for x in {tuple(w[k : k + multiset_hash.WORDS]) for k in range(max(1, len(w) - multiset_hash.WORDS + 1))} if w else ():
            out[x] += 1
    return out


def dice(a, b):
    x, y = shingles_of(a), shingles_of(b)
    norms = sum(n * n for n in x.values()) + sum(n * n for n in y.values())
    return 1.0 if a == b else 2 * sum(n * y.get(k, 0) for k, n in x.items()) / norms if norms else 0.0


def test_edited_fingerprints(documents):
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    found = {r.doc_id: r for r in multiset_hash.edited_fingerprints(documents).collect()}
    far, names = [], defaultdict(set)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half] if half else t
        r = found[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        names[r.fingerprint].add(tuple(sorted(t.split("\n")) if t else ()))
        names[r.edited_fingerprint].add(tuple(sorted(new.split("\n")) if new else ()))
        far += [r.near_edited - dice(t, new), r.near_next - dice(t, after)]
    assert all(len(x) == 1 for x in names.values()) and len(names) == len({next(iter(x)) for x in names.values()})
    assert np.mean(np.abs(far)) < 0.015 and np.max(np.abs(far)) < 0.08


def test_vectors_follow_their_paragraphs(documents):
    h = multiset_hash.Hasher()
    for r in multiset_hash.fingerprint_vectors(documents.withColumn("vector", F.lit(1))).limit(50).join(documents, "doc_id").collect():
        v, parts = multiset_hash.unpack(r.vector), multiset_hash.paragraphs(r.text)
        shorter = multiset_hash.remove(v, h.paragraph(parts[0])) if parts else v
        assert r.fingerprint == multiset_hash.digest(v) == multiset_hash.digest(multiset_hash.total(map(h.paragraph, reversed(parts))))
        assert multiset_hash.digest(shorter) == multiset_hash.digest(h.text("\n".join(parts[1:]))) or len(parts) == 2 and not parts[1]


def test_edited_fingerprints_of_messy_rows(spark, messy):
    found = multiset_hash.edited_fingerprints(messy).collect()
    assert len(found) == 9 and len({r.fingerprint for r in found if r.doc_id == 1}) == 2
    assert multiset_hash.edited_fingerprints(messy.limit(0)).collect() == []
    alone = multiset_hash.edited_fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_edited_fingerprints_of_a_hot_id(spark):
    """A third of all rows has one id, and many of those one text."""
    rows = [(7, f"text number {k} of one id") for k in range(150)] + [(7, "the same")] * 150 + [(k, f"text {k}") for k in range(100, 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = multiset_hash.edited_fingerprints(df).collect()
    order = [(r.doc_id, r.text) for r in df.orderBy("doc_id", F.xxhash64("text")).collect()]
    wanted = [(i, hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(order)]
    assert sorted((r.doc_id, r.edited_sha256) for r in found) == sorted(wanted)
    bounds = multiset_hash._bounds([7] * 9 + [100, 200])
    assert len(bounds) == 11 and bounds == sorted(bounds) and len({b for b in bounds if b[0] == 7}) == 9


# op2


def brute_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(v >> b & 1 for v in h) > len(h))


def roots(n, near):
    f = simhash._Forest(n)
    for k in range(n):
        j = np.flatnonzero(near(k))
        f.add(np.full(len(j), k), j)
    return f.root


@pytest.mark.parametrize("width,words,budget", [(4, 1, 4), (5, 2, 19)])
def test_simhash_components(documents, width, words, budget):
    found = simhash.near_duplicates(documents.select(F.col("doc_id").alias("key"), "text"), width, words, budget).toPandas()
    x0, x1 = (found[c].to_numpy().view(np.uint64) for c in ("f0", "f1"))
    root = roots(len(found), lambda k: np.bitwise_count(x0 ^ x0[k]).astype(int) + np.bitwise_count(x1 ^ x1[k]) <= budget)
    assert (found.groupby(root)["key"].transform("min") == found["first"]).all()
    texts = {r.doc_id: r.text for r in documents.collect()}
    for k, f in list(zip(found["key"], x0.tolist()))[:60]:
        assert f == brute_fingerprint(texts[k], width)


def test_simhash_with_hot_nodes(spark, monkeypatch):
    """One clump of near fingerprints, split into many jobs, and a chain through single steps."""
    monkeypatch.setattr(simhash, "LEAST_JOB", 8)
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    clump = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))}
    chain = [0]
    for k in range(40):
        chain.append(chain[-1] ^ (7 << (k % 20) * 3))
    values = np.array(sorted({*clump, *chain, *map(int, rng.integers(0, 2**63, 300))}), np.int64)
    df = spark.createDataFrame([(int(v), int(v), 0) for v in values], "id long, f0 long, f1 long")
    got = {r.id: r.root for r in simhash.components(simhash.links(df, 4)).collect()}
    u = values.view(np.uint64)
    root = roots(len(u), lambda k: np.bitwise_count(u ^ u[k]) <= 4)
    groups = defaultdict(set)
    for v, r in zip(values.tolist(), root):
        groups[r].add(got.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_exact_similarity(spark, sf):
    """With ``least`` documents go for partners of that similarity only, and nearly all such pairs are found."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs, least=0.8, budget=26, errors=1).collect()}
    sets, at = {}, defaultdict(list)
    for k, t in texts.items():
        w = t.lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        for x in sets[k]:
            at[x].append(k)
    near = {(a, b) for ks in at.values() for a in ks for b in ks if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert near and all(any(k in p for p in near) for k in texts.keys() - kept)
    assert np.mean([a in kept and b in kept for a, b in near]) < 0.05


def edited_copies(n, part, seed=8):
    """Copies of one text of 400 words with a part of them replaced, and which pairs have a Jaccard similarity of 0.8."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 5000, 400)
    texts = [" ".join(f"w{x}" for x in np.where(rng.random(400) < part, rng.integers(5000, 10**6, 400), base)) for _ in range(n)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    return texts, np.array([[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])


def passes(f):
    """Pairs of rows of which some block of twelve bits has no more than one differing bit."""
    x, out = f[:, None] ^ f, False
    for word in range(2):
        for k in range(simhash.BLOCKS):
            turned = x[:, :, word] << np.uint64(12 * k) | x[:, :, word] >> np.uint64((64 - 12 * k) % 64)
            out = out | (np.bitwise_count(turned >> np.uint64(52)) <= 1)
    return out


def test_all_candidates_of_a_group_are_verified(spark):
    """A refused candidate must not hide others between the same trees."""
    texts, near = edited_copies(200, 0.012)
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    found = sorted((r.key, r["first"]) for r in simhash.near_duplicates(docs, least=0.8, budget=26, errors=1).collect())
    f = np.array([[r.f0, r.f1] for r in sorted(simhash.fingerprints(docs, 5, 2, once=True).collect())]).view(np.uint64)
    far = np.bitwise_count(f[:, None] ^ f).astype(int)
    candidates = near & (far.sum(2) <= 26) & passes(f)
    first, true = np.array([b for _, b in found]), roots(len(texts), lambda k: near[k])
    a, b = np.nonzero(candidates)
    assert len(a) > len(texts) and (first[a] == first[b]).all() and (true[first] == true).all()


@pytest.mark.parametrize("node", [8, 10**6])
def test_nodes_of_any_size_keep_the_same_bound(spark, monkeypatch, node):
    """13 differing bits in each word, in nodes that are walked down far, whatever the shuffle has done before."""
    monkeypatch.setattr(simhash, "NODE", node)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**62, 2)

    def flipped(n):
        return [int(b) ^ sum(1 << int(k) for k in rng.choice(62, n, False)) for b in base]

    rows = [(k, *flipped(1)) for k in range(1500)] + [(1500 + k, *flipped(13)) for k in range(100)]
    f = np.array(rows)[:, 1:]
    near = (np.bitwise_count(f[:, None] ^ f).astype(int).sum(2) <= 26) & passes(f.view(np.uint64))
    root = roots(len(rows), lambda k: near[k])
    found = simhash._Forest(len(rows))
    found.add(*np.array([(r.a, r.b) for r in simhash.links(spark.createDataFrame(rows, "id long, f0 long, f1 long"), 26, 2, 1, True).collect()]).T)
    assert (found.root == root).all()


def test_direct_links_are_close_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 2)
    rows = [(k, int(base[0]) ^ (1 << int(a)), int(base[1]) ^ (1 << int(b))) for k, (a, b) in enumerate(rng.integers(0, 62, (80, 2)))]
    found = [(r.a, r.b) for r in simhash.links(spark.createDataFrame(rows, "id long, f0 long, f1 long"), 19, 2, direct=True).collect()]
    assert found and all(bin(rows[a][1] ^ rows[b][1]).count("1") + bin(rows[a][2] ^ rows[b][2]).count("1") <= 4 for a, b in found)
    forest = simhash._Forest(80)
    forest.add(*np.array(found).T)
    assert (forest.root == 0).all()


def test_simhash_of_messy_rows(messy):
    found = simhash.near_duplicates(messy.select(F.col("doc_id").alias("key"), "text"), 4, 1, 4).collect()
    assert len(found) == 9 and {r["first"] for r in found if r.f0 == 0} == {2}
    assert simhash.drop_near_duplicates(messy, least=0.8, budget=26, errors=1).count() == simhash.drop_near_duplicates(messy).count()
    kept = simhash.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    assert sorted(((r.doc_id, (r.text or "")[:5]) for r in kept.collect()), key=str)[:2] == [(1, "a b c"), (1, "other")]
    assert kept.where("doc_id = 1 AND text = 'a b c'").count() == 1 and kept.where("text IS NULL OR trim(text) = ''").count() == 1 and kept.where("text = 'no id'").count() == 1
    assert simhash.drop_near_duplicates(messy.limit(0)).collect() == []


# op6


def brute_lines(rows, least=50):
    held, at, out = [], defaultdict(list), []
    for d, (_, text) in enumerate(rows):
        lines = (text or "").split("\n")
        own = [(x.strip(" \t\r"), k) for k, x in enumerate(lines) if x.strip(" \t\r")]
        held.append(own)
        offsets = set()
        for p, (x, _) in enumerate(own):
            offsets |= {(c, p - q) for c, q in at[x]}
            at[x].append((d, p))
        gone = set()
        for c, off in offsets:
            run = []
            for p in range(max(0, off), min(len(own), len(held[c]) + off) + 1):
                if p < min(len(own), len(held[c]) + off) and own[p][0] == held[c][p - off][0]:
                    run.append(p)
                    continue
                if sum(len(own[z][0].split()) for z in run) >= least:
                    gone.update(range(own[run[0]][1], own[run[-1]][1] + 1))
                run = []
        out.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


@pytest.mark.parametrize("sf_name", ["sf0.001", "sf0.1"])
def test_line_dedup(spark, sf, sf_name):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', sf_name)}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    found = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    wanted = brute_lines(rows)
    assert [found[i].text for i, _ in rows] == wanted and any(w != t for w, (_, t) in zip(wanted, rows))
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_line_dedup_of_passages(spark, messy):
    passage = "\n".join(f"line {k} of this text with some more words" for k in range(12))
    short = "only a few words"
    single = " ".join(f"w{k}" for k in range(57))
    rows = [(1, passage, 0), (2, f"head\n\n{passage}\ntail", 0), (2, f"head\n\n{passage}\ntail", 0), (3, f"{passage}\n{passage}", 0), (4, short, 0), (5, short, 0), (6, f"x\n{single}", 0), (7, f"{single}\ny", 0), (None, single, 0)]
    found = [(r.doc_id, r.text, r.removed_lines) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, h long")).collect()]
    assert sorted(found, key=str) == sorted([(1, passage, 0), (2, "head\n\ntail", 12), (2, "head\n\ntail", 12), (3, "", 24), (4, short, 0), (5, short, 0), (6, "x", 1), (7, "y", 1), (None, single, 0)], key=str)
    out = line_dedup.dedup_lines(messy)
    assert out.columns == [*messy.columns, "removed_lines"] and out.count() == 9 and out.where("doc_id = 3").first().text is None
    assert line_dedup.dedup_lines(messy.limit(0)).collect() == []


# op8


GIVEN = {"source": {"src0": 0.2, "src1": 0.06, "*": 0.74}, "lang": {"en": 0.5, "*": 0.5}, "topic": 1.0}


def goals_of(out, targets):
    """Class of each row and target shares by class."""
    for name, goal in targets.items():
        if isinstance(goal, dict):
            classes = out[name].where(out[name].isin(list(goal)), "*")
        else:
            classes = out[name].fillna("*")
            classes = classes.where(out["tokens"].groupby(classes).transform("sum") >= mixing.LEAST_SHARE * out["tokens"].sum(), "*")
        own = out["tokens"].groupby(classes).sum().astype(float)
        own = own[own > 0] / own.sum()
        if isinstance(goal, dict):
            g = own.index.to_series().map(goal).fillna(0)
            g /= g.sum()
        else:
            named = own.index != "*"
            g = own.where(~named, own**goal / (own[named] ** goal).sum() * own[named].sum())
        yield classes, g


def weighed(docs, *args, **options):
    return mixing.weigh(docs, *args, **options).select("row.doc_id", "row.source", "row.lang", "row.text", "topic", "tokens", "weight", "rate", "copies")


@pytest.mark.parametrize("hot", ["src0", "src7"])
def test_mixing_meets_its_targets(spark, sf, hot):
    """Whichever source is hot, by rate, and nearly so in the sample."""
    from pactspark.llm.queries import MIXTURE

    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(hot)).otherwise(F.col("source")))
    for targets in (MIXTURE, GIVEN):
        out = weighed(docs, targets).toPandas()
        assert 0 < out["rate"].max() <= 1.0 and set(out["copies"]) <= {0, 1}
        for mass, far in ((out["tokens"] * out["rate"], mixing.MET), (out["tokens"] * out["copies"], 0.03)):
            assert all((abs(mass.groupby(c).sum() / mass.sum() - g).fillna(0) <= far).all() for c, g in goals_of(out, targets))
        print(hot, "kept share of tokens", (out["tokens"] * out["rate"]).sum() / out["tokens"].sum())


@pytest.mark.parametrize("amount,most", [(1.0, 1.0), (0.1, 1.0), (3.0, 5.0)])
def test_mixing_against_numpy(documents, amount, most):
    from pactspark.llm.queries import MIXTURE

    out = weighed(documents, MIXTURE, amount, most).toPandas()
    rows = list(goals_of(out, MIXTURE))
    cells = out["tokens"].groupby([c for c, _ in rows]).sum().astype(float)
    cells = cells[cells > 0]
    room = most * min((cells.groupby(level=k).sum() / g).min() for k, (_, g) in enumerate(rows))
    for level in [*mixing.LEVELS, None]:
        goal, w = min(amount * cells.sum(), room) * (level or mixing.LEVELS[-1]), cells
        for _ in range(mixing.SWEEPS):
            for k, (_, g) in enumerate(rows):
                w = w * w.index.get_level_values(k).map(goal * g / w.groupby(level=k).sum()).to_numpy()
                w = np.minimum(w, most * cells) if level else w
        if not level or max(abs(w.groupby(level=k).sum() / goal - g).max() for k, (_, g) in enumerate(rows)) <= mixing.MET:
            break
    rate = w / cells * min(1, most / (w / cells).max())
    for *key, tokens, weight, r in out.assign(**{f"k{k}": c for k, (c, _) in enumerate(rows)})[["k0", "k1", "k2", "tokens", "weight", "rate"]].itertuples(index=False):
        if tokens:
            assert abs(w[tuple(key)] / w.sum() - weight) < 1e-6 and abs(rate[tuple(key)] - r) < 1e-6


def test_topics_are_widespread_long_words(documents):
    texts = [re.findall(r"[^ \t\r\n\x0b\f]+", r.text.lower()) for r in documents.select("text").collect()]
    long = [[w for x in t if len(w := x.strip(mixing.TRIMMED)) >= 7] for t in texts]
    spread = defaultdict(int)
    for t in long:
        for w in set(t):
            spread[w] += 1
    words = sorted((w for w in spread if 2 * spread[w] <= len(texts)), key=lambda w: (-spread[w], w.encode()))[: mixing.TOPICS]
    assert mixing.topic_words(documents) == words
    wanted = [max(words, key=lambda w: (t.count(w), -words.index(w))) if any(w in t for w in words) else "none" for t in long]
    out = mixing.weigh(documents, GIVEN).select("row.text", "topic", "tokens").collect()
    assert sorted((r.text, r.topic, r.tokens) for r in out) == sorted((r.text, w, len(t)) for r, w, t in zip(documents.select("text").collect(), wanted, texts))


def test_mixing_by_joins_and_with_repeats(documents, monkeypatch):
    docs, targets = documents.withColumn("topic", F.col("lang")), GIVEN | {"topic": {"en": 0.5, "*": 0.5}}  # a column of its own is taken
    one = weighed(docs, targets, 2.0, 10.0).toPandas()
    assert set(one["topic"]) == set(one["lang"]) and one["copies"].max() > 1 and abs((one["tokens"] * one["rate"]).sum() / one["tokens"].sum() - 2) < 0.02
    assert mixing.sample(docs, targets, 2.0, 10.0).count() == one["copies"].sum()
    monkeypatch.setattr(mixing, "ARRAY_CELLS", 0)
    monkeypatch.setattr(mixing, "SETTLED", 1e-6)
    two = weighed(docs, targets, 2.0, 10.0).toPandas()
    keys = ["doc_id", "text"]
    assert np.allclose(one.sort_values(keys)["rate"], two.sort_values(keys)["rate"], atol=1e-3)


def test_mixing_of_messy_rows(messy):
    found = mixing.weigh(messy, GIVEN)
    rows = found.collect()
    assert len(rows) == 9 and all(r.copies == 1 and r.rate == 1 for r in rows if not r.tokens) and {r.topic for r in rows if not r.row.text} == {"none"}
    assert mixing.sample(messy.withColumn("topic", F.lit(None)).withColumn("copies", F.lit(3)), GIVEN).columns == [*messy.columns, "topic", "copies"]
    assert {(r.marginal, r["class"]) for r in mixing.shares(found, GIVEN).collect()} >= {("source", "src0"), ("lang", "en")}
    assert mixing.weigh(messy.limit(0), GIVEN).collect() == [] and mixing.sample(messy.limit(0), GIVEN, 2.0, 2.0).collect() == []


# op3


@pytest.fixture(scope="module")
def piece_model():
    return pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abehinrst  ▁\n\t.,;:$*'\"éß漢🎉0Σ<>_\x00"), max_size=80), max_size=5))
def test_pieces_match_the_library(piece_model, library, texts):
    ids = piece_model.encode(texts)
    assert ids == library.encode(texts)
    assert [piece_model.decode(x) for x in ids] == [library.decode(x) for x in ids]


def test_suffix_array():
    codes = np.array([ord(c) for c in "banana\U0010ffffbandana"])
    order = pieces.suffix_array(codes, 16)
    assert order.tolist() == sorted(range(len(codes)), key=lambda k: codes[k:].tolist())
    words = np.zeros((3, 4), np.int64)
    for k, w in enumerate(("an", "ban", "x")):
        words[k, : len(w)] = [ord(c) for c in w]
    lo, hi = pieces.occurrences(codes, order, words, np.array([2, 3, 1]))
    assert (hi - lo).tolist() == [4, 2, 0]


def test_encoding_documents(spark, documents, messy, library):
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.encode_documents(documents, path)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in found.collect():
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip
    assert {r.doc_id: r.text for r in pieces.decode_documents(found, path).collect()} == texts
    odd = pieces.encode_documents(messy, path).collect()
    assert len(odd) == 9 and {tuple(r.ids) for r in odd if r.doc_id in (2, 3)} == {()} and all(r.round_trip for r in odd)
    assert pieces.encode_documents(messy.limit(0), path).collect() == []
    assert pieces.decode_documents(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).first().text is None


# op1


@pytest.mark.parametrize("sf_name", ["sf0.01", "sf0.1"])
def test_quality_on_the_held_out_fold(spark, sf, sf_name):
    sf = sf.replace("sf0.001", sf_name)
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.featurise(docs, ["doc_id"])
    model = quality.train(rows, labels)
    found = quality.score_documents(rows, model).join(labels, "doc_id").toPandas()
    held = found[found["held_out"]]
    share = labels.where("quality = 1").count() / labels.count()
    print("prior", model.prior, "share of positives among labels", share, "accuracy", (held["predicted"] == held["quality"]).mean())
    assert abs(model.prior - share) < 0.08
    assert (held["predicted"] == held["quality"]).mean() > 0.97 and found["score"].between(0, 1).all() and ((found["score"] >= 0.5) == (found["predicted"] == 1)).all()


def test_quality_of_messy_rows(spark, sf, messy):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(quality.featurise(docs), labels)
    rows = quality.featurise(messy.withColumn("x", F.lit(1)).withColumn("score", F.lit("a")))
    odd = quality.score_documents(rows, model).collect()
    assert len(odd) == 9 and len({r.score for r in odd if r.doc_id in (2, 3)}) == 1 and not any(r.held_out for r in odd if r.doc_id is None)
    kept = quality.keep_good(rows, model, 0.0)
    assert kept.columns == [*messy.columns, "x", "score"] and kept.count() == 9
    nothing = quality.train(quality.featurise(docs.limit(0)), labels.limit(0))
    assert quality.score_documents(rows, nothing).where("score = 0.5").count() == 9 and quality.score_documents(quality.featurise(messy.limit(0)), model).collect() == []
    assert quality.keep_good(quality.featurise(docs.limit(0)), nothing).columns == docs.columns


def test_labels_that_are_not_read(spark, sf):
    """Those of the held-out fold, those other than 1, and ids with both."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.featurise(docs)
    held = quality.held_out(F.col("doc_id"))
    good = [r.doc_id for r in labels.where("quality = 1").where(~held).orderBy("doc_id").limit(1).collect()]
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).when(F.col("quality") == 0, F.element_at(F.array(*map(F.lit, (-1, 2, None))), (F.col("doc_id") % 3 + 1).cast("int"))).otherwise(F.col("quality")))
    more = turned.unionByName(turned.where("quality = 1").withColumn("quality", F.when(F.col("doc_id") == good[0], F.lit(1)).otherwise(F.lit(None).cast("int"))))
    conflicting = labels.unionByName(labels.where(F.col("doc_id") == good[0]).withColumn("quality", F.lit(0)))
    one, two, three, four = (quality.train(rows, x) for x in (labels, more, conflicting, labels.where(F.col("doc_id") != good[0])))
    assert all(np.array_equal(a, b) for a, b in zip(one.weights, two.weights)) and one.prior == two.prior
    assert all(np.array_equal(a, b) for a, b in zip(three.weights, four.weights))


def brute_risk(weights, zp, zu, prior):
    def loss(z, y):
        return np.mean([1 / (1 + np.exp(y * float(np.tanh(row @ weights[0] + weights[1]) @ weights[2][:, 0] + weights[3][0]))) for row in z])

    return prior * loss(zp, 1) + max(0, loss(zu, -1) - prior * loss(zp, -1))


def test_risk_and_its_gradient():
    rng = np.random.default_rng(2)
    zp, zu = rng.normal(0.3, 1, (40, 5)), rng.normal(0, 1, (60, 5))
    weights = [rng.normal(size=s) for s in ((5, 3), (3,), (3, 1), (1,))]
    for prior in (0.2, 0.4):
        value, step = quality.risk(quality.sums(weights, zp), quality.sums(weights, zu), prior)
        assert abs(value - brute_risk(weights, zp, zu, prior)) < 1e-12
        slopes, plain = [], brute_risk(weights, zp, zu, prior)
        for w in weights:
            for k in np.ndindex(w.shape):
                w[k] += 1e-6
                slopes.append((brute_risk(weights, zp, zu, prior) - plain) / 1e-6)
                w[k] -= 1e-6
        assert np.abs(step - slopes).max() < 1e-4
    # where the negative part is below zero, the step raises it
    value, step = quality.risk(np.r_[1.0, 0.9, np.ones(4)], np.r_[1.0, 0.1, np.zeros(4)], 0.5)
    assert abs(value - 0.05) < 1e-12 and (step == 0.5).all()


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_prior_from_positives_and_unlabelled_rows(prior):
    rng = np.random.default_rng(0)
    n = int(4000 * prior)
    good, web = rng.normal(1.5, 1, (1500, 4)), np.vstack([rng.normal(1.5, 1, (n, 4)), rng.normal(-1.5, 1, (4000 - n, 4))])
    scorer = quality.fit(good[::2], web, None)
    found = quality.best_ratio(*(np.histogram(scorer.score(x), quality.BINS, (0, 1))[0].astype(float) for x in (good[1::2], web)))
    assert abs(found - prior) < 0.06
    model = quality.fit(good, web, found)
    assert (model.score(web[:n]) > 0.5).mean() > 0.9 and (model.score(web[n:]) < 0.5).mean() > 0.9
