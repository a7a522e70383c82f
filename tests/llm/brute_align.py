"""A plain version of the alignment, token by token."""

import collections
import hashlib
import json
import re

import public_tokenizers as P


def tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocab = json.load(open(P.path("byte_bpe_50k.json")))["model"]["vocab"]
    a = {i: b"" if name == "<|endoftext|>" else bytes(letter[c] for c in name) for name, i in vocab.items()}
    s = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    b = {i: s.id_to_piece(i) for i in range(s.vocab_size())}
    b = {i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for i, p in b.items()}
    return lambda x: t.encode(" " + x, add_special_tokens=False).ids, lambda x: s.encode(x), a, b


def alignments(rows):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of (doc_id, text) rows."""
    enc_a, enc_b, byte_a, byte_b = tokens()
    found = []
    for doc_id, text in rows:
        a, b = (enc_a(text), enc_b(text)) if text else ([], [])
        want = (" " + text).encode() if text else b""
        if not text or b"".join(byte_a[i] for i in a) != want or b"".join(byte_b[i] for i in b) != want:
            found.append((doc_id, [], [], [], []))
            continue
        spans = []
        for ids, of in ((a, byte_a), (b, byte_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(of[i]), i))
                at += len(of[i])
            spans.append(out)
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [([i for s, e, i in spans[0] if lo <= s and e <= hi], [i for s, e, i in spans[1] if lo <= s and e <= hi]) for lo, hi in zip([0, *common], common)] if len(text) < 3000 else None
        if groups is None:
            groups, ka, kb = [], 0, 0
            for hi in common:
                g = ([], [])
                while ka < len(a) and spans[0][ka][1] <= hi:
                    g[0].append(a[ka])
                    ka += 1
                while kb < len(b) and spans[1][kb][1] <= hi:
                    g[1].append(b[kb])
                    kb += 1
                groups.append(g)
        links, kb = [], 0
        for s, e, i in spans[0]:
            while spans[1][kb][1] <= s:
                kb += 1
            k = kb
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        found.append((doc_id, a, b, groups, links))
    count = collections.Counter(p for *_, links in found for p in set(links))
    best = collections.defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for doc_id, a, b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out
