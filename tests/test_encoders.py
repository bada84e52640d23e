import hashlib
import json
import math

import numpy as np
import pytest

from tracelode.config import RunConfig
from tracelode.operators import encode
from tracelode.plans import pipeline

public_tokenizers = pytest.importorskip("public_tokenizers")
D, HEADS, HIDDEN, POSITIONS = 8, 2, 12, 24


def weights_file(folder, name, seed, layers=2):
    """Random weights over the vocabulary of a public tokenizer, and the tokenizer beside them."""
    source = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(seed)
    made = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    w = {"word": made(49408, D), "position": made(POSITIONS, D), "norm_scale": 1 + made(D), "norm_shift": made(D)}
    for i in range(layers):
        w |= {f"{i}_qkv": made(D, 3 * D), f"{i}_qkv_bias": made(3 * D), f"{i}_out": made(D, D), f"{i}_out_bias": made(D), f"{i}_up": made(D, HIDDEN), f"{i}_up_bias": made(HIDDEN)}
        w |= {f"{i}_down": made(HIDDEN, D), f"{i}_down_bias": made(D), **{f"{i}_norm{k}_{s}": made(D) + (s == "scale") for k in (1, 2) for s in ("scale", "shift")}}
    settings = json.dumps({"heads": HEADS, "eps": 1e-5, "first": "<|startoftext|>", "last": "<|endoftext|>", "pad": "<|endoftext|>"})
    np.savez(folder / f"{name}.npz", settings=settings, **w)
    (folder / f"{name}.json").write_bytes(open(source, "rb").read())
    return str(folder / f"{name}.npz"), w


def norm(row, scale, shift):
    mean = sum(row) / len(row)
    var = sum((x - mean) ** 2 for x in row) / len(row)
    return [(x - mean) / math.sqrt(var + 1e-5) * a + b for x, a, b in zip(row, scale, shift, strict=True)]


def dense(row, m, bias):
    return [sum(x * m[i][j] for i, x in enumerate(row)) + bias[j] for j in range(len(bias))]


def by_hand(w, ids, real):
    """One sentence, number by number."""
    w = {k: v.astype(float).tolist() for k, v in w.items() if k != "word"} | {"word": w["word"]}
    x = [norm([float(a) + b for a, b in zip(w["word"][t], w["position"][i], strict=True)], w["norm_scale"], w["norm_shift"]) for i, t in enumerate(ids)]
    size = D // HEADS
    for layer in range(2):
        qkv = [dense(r, w[f"{layer}_qkv"], w[f"{layer}_qkv_bias"]) for r in x]
        mixed = []
        for r in qkv:
            row = []
            for h in range(HEADS):
                q = r[h * size : (h + 1) * size]
                e = [math.exp(sum(a * b for a, b in zip(q, k[D + h * size :], strict=False)) / math.sqrt(size)) if ok else 0.0 for k, ok in zip(qkv, real, strict=True)]
                row += [sum(p * v[2 * D + h * size + j] for p, v in zip(e, qkv, strict=True)) / sum(e) for j in range(size)]
            mixed.append(row)
        out = [dense(r, w[f"{layer}_out"], w[f"{layer}_out_bias"]) for r in mixed]
        x = [norm([a + b for a, b in zip(r, o, strict=True)], w[f"{layer}_norm1_scale"], w[f"{layer}_norm1_shift"]) for r, o in zip(x, out, strict=True)]
        up = [[v * 0.5 * (1 + math.erf(v / math.sqrt(2))) for v in dense(r, w[f"{layer}_up"], w[f"{layer}_up_bias"])] for r in x]
        x = [norm([a + b for a, b in zip(r, dense(u, w[f"{layer}_down"], w[f"{layer}_down_bias"]), strict=True)], w[f"{layer}_norm2_scale"], w[f"{layer}_norm2_shift"]) for r, u in zip(x, up, strict=True)]
    return np.array(x)


def test_ids_and_a_forward_pass(tmp_path):
    from tokenizers import Tokenizer

    path, w = weights_file(tmp_path, "a", 1)
    model = encode.named(path, 10)()
    sentences = ["error in block", "", "a very long line of a log that is cut at the end of the window of the model"]
    ids, real = model.ids(sentences)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for s, row, ok in zip(sentences, ids.tolist(), real.tolist(), strict=True):
        bare = plain.encode(s, add_special_tokens=False).ids[:8]
        assert row == [49406, *bare, 49407] + [49407] * (8 - len(bare)) and sum(ok) == len(bare) + 2
    for s, i, ok in zip(model.encode(sentences), ids.tolist(), real.tolist(), strict=True):
        assert s.shape == (10, D) and np.allclose(s, by_hand(w, i, ok), atol=2e-5)
    with pytest.raises(ValueError):
        encode.named(path, POSITIONS + 1)()


def test_two_encoders_of_a_grid(spark, tmp_path):
    paths = [weights_file(tmp_path, n, s)[0] for n, s in (("one", 1), ("two", 2))]
    for name, path in zip(("first-model", "second-model"), paths, strict=True):
        encode.register(name, path, path.replace(".npz", ".json"))
    try:
        rows = [(i, None, None, f"{'failure of' if i % 7 == 0 else 'block'} {i % 12}", int(i % 7 == 0), "train" if i % 3 and i % 7 else "test") for i in range(60)]
        records = spark.createDataFrame(rows, "line_no long, ts timestamp, session_id string, sentence string, label int, split string")
        configs = [RunConfig(encoder=n, core_set=0.1, max_tokens=12) for n in ("first-model", "second-model")]
        report = pipeline.run_grid(spark, lambda c: pipeline.represent(records, c), configs, str(tmp_path / "out")).collect()
        assert len(report) == 6 and len({r.experiment for r in report}) == 2
    finally:
        del encode.ENCODERS["first-model"], encode.ENCODERS["second-model"]


def test_words_by_the_generator_of_their_seed():
    seeds = [0, 1, 2**32 - 1, 2**32, 2**64 - 1, 0x0123456789ABCDEF]
    states = encode.seed_states(np.array([[s & 0xFFFFFFFF, s >> 32] for s in seeds], np.uint32))
    assert states.tolist() == [np.random.SeedSequence(s).generate_state(4, np.uint64).tolist() for s in seeds]

    def vector(word):
        v = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little"))).standard_normal(16)
        return (v / np.linalg.norm(v)).astype(np.float32)

    sentences = ["one two  one", "", "a b c d e f", "two\u2003three"]
    for matrix, words in zip(encode.HashEncoder(max_tokens=5).encode(sentences), (["one", "two", "one"], [], ["a", "b", "c", "d"], ["two", "three"]), strict=True):
        rows = np.stack([vector(w) for w in (words + ["[PAD]"] * 4)[:4]])
        assert (matrix[1:] == rows).all() and (matrix[0] == rows[: max(1, len(words))].mean(axis=0)).all()


def test_words_are_kept_from_task_to_task(monkeypatch):
    encode.HashEncoder().encode(["met before"])
    monkeypatch.setattr(encode, "seed_states", None)
    assert len(encode.HashEncoder(max_tokens=4).encode(["before met"])) == 1


def test_pass_through_takes_equal_slices_alone(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "k long, v array<double>")
    assert encode.pass_through(df, "k", "v", 3).first().tokens == [[1.0], [2.0], [3.0]]
    with pytest.raises(Exception, match="does not divide"):
        encode.pass_through(df, "k", "v", 2).collect()
