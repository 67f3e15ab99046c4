import random

import pytest
from test_mp3_spectra import RATE, spectra

from strandflow.functions import celt
from strandflow.plans.media import _vorbis
from strandflow.sources import mp3_code, mp3_spectra, ogg, opus_entropy, vorbis_audio, vorbis_code


def link_packets(key):
    held, out = b"", []
    for p in ogg.parse(_vorbis(key))[0]:
        at = 0
        for n in p.lace:
            held, at = held + p.body[at : at + n], at + n
            if n < 255:
                out.append(held)
                held = b""
    return out


def test_vorbis_packets_round_trip():
    for key in range(3):
        ident, _, setup, *audio = link_packets(key)
        g = vorbis_audio.grammar_of(ident, setup)
        packets = [*audio, b"", b"\x01header", b"\x00", audio[0]]
        coded = vorbis_code.code_packets(g, packets)
        assert vorbis_code.decode_packets(g, coded, len(packets)) == packets
    many = audio * 8  # what comes again costs little
    assert len(vorbis_code.code_packets(g, many)) < 5 * len(vorbis_code.code_packets(g, audio))  # though their tails are noise


def test_granules_round_trip():
    t = mp3_spectra.Tables()
    coder, given = mp3_code.GranuleCoder(t, RATE), []
    for k, lines in enumerate(list(spectra())[:6]):
        g = mp3_spectra.plan(t, lines, RATE) | {"global_gain": 150 + k, "scalefac": k}
        raw, bits = mp3_spectra.emit(t, lines, g, RATE)
        given.append((g, raw, bits))
        out, again, n = coder.granule(g, raw, bits)
        assert (again, n) == (raw, bits)
    back = mp3_code.GranuleCoder(t, RATE, coder.finish())
    for g, raw, bits in given:
        out, again, n = back.granule(None, None)
        assert (again, n) == (raw, bits) and all(out[k] == g[k] for k in ("big_values", "global_gain", "table_select", "count1", "scalefac"))


def test_a_payload_of_other_words_is_refused():
    t = mp3_spectra.Tables()
    lines = [1, 0] * 20 + [0] * 536
    g = mp3_spectra.plan(t, lines, RATE)
    raw, bits = mp3_spectra.emit(t, lines, g, RATE)
    with pytest.raises(ValueError, match="tables"):
        mp3_code.GranuleCoder(t, RATE).granule(g, raw + b"\x55", bits)


TABLES = [((128, 0), 8), ((200, 100, 20, 0), 8), ((31, 15, 3, 0), 5), ((0,), 4)]


def operations(rng, n):
    out = []
    for _ in range(n):
        kind = rng.choice(["logp", "icdf", "uint", "bits", "laplace"])
        if kind == "logp":
            params = (rng.randrange(1, 16),)
            v = int(rng.random() < 2.0 ** -params[0])
        elif kind == "icdf":
            params = rng.choice(TABLES)
            v = rng.randrange(len(params[0]))
        elif kind == "uint":
            params = (rng.choice([2, 5, 200, 257, 100_000, (1 << 31) - 7]),)
            v = rng.randrange(params[0])
        elif kind == "bits":
            params = (rng.randrange(1, 14),)
            v = rng.randrange(1 << params[0])
        else:
            params = (rng.randrange(2000, 20000), rng.randrange(3000, 11000))
            v = rng.choice([0, 0, 1, -1, 2, -3, 5])
        out.append(opus_entropy.Operation(kind, f"site{rng.randrange(4)}", params, v))
    return out


def ask(d, op):
    return getattr(d, op.kind)(op.site, *op.params)


@pytest.mark.parametrize("seed", range(40))
def test_operations_round_trip(seed):
    rng = random.Random(seed)
    ops = operations(rng, rng.randrange(1, 200))
    e = opus_entropy.Encoder()
    for op in ops:
        e.put(op)
    data = e.finish()
    for padded in (data, opus_entropy.replay(ops, len(data) + 7)):
        d = opus_entropy.Decoder(padded)
        assert [ask(d, op) for op in ops] == [op.value for op in ops]
        assert d.record == ops
        assert opus_entropy.differences(padded, d.record) == []
    assert opus_entropy.replay(ops, 0) is None or not ops or len(data) == 0


def test_a_frame_of_another_encoder_is_patched():
    rng = random.Random(3)
    ops = operations(rng, 60)
    data = bytearray(opus_entropy.replay(ops, 400))
    data[200] ^= 0x5A  # bytes that no operation reads
    d = opus_entropy.Decoder(bytes(data))
    assert [ask(d, op) for op in ops] == [op.value for op in ops]
    assert opus_entropy.differences(bytes(data), d.record) == [(200, data[200])]


def test_operations_in_their_contexts():
    rng = random.Random(5)
    ops = operations(rng, 30) * 8
    coder = opus_entropy.OperationCoder()
    for op in ops:
        assert coder.value(op.kind, op.site, op.params, op.value) == op.value
    data = coder.finish()
    back = opus_entropy.OperationCoder(data)
    assert [back.value(op.kind, op.site, op.params, None) for op in ops] == [op.value for op in ops]
    assert len(data) < len(opus_entropy.replay(ops, 4000).strip(b"\0"))


def test_laplace_covers_its_range():
    for zero, decay in ((6000, 8000), (20000, 3000), (2000, 11000)):
        spans = sorted(celt.laplace_interval(v, zero, decay) for v in range(-12, 13))
        at = 0
        for low, size in spans:
            if size:
                assert low == at
                at = low + size
