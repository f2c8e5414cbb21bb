"""Encryption by password: packages (Agile with AES-CBC and any SHA, Standard with AES-ECB and SHA-1) and binary
documents (RC4)."""

from __future__ import annotations

import base64
import hashlib
import hmac
import struct
from functools import cache

import numpy as np

from .containers import NotAContainer, open_compound
from .docx import Encrypted
from .xmltree import parse

#: What the format mixes into derived keys.
VERIFIER_INPUT, VERIFIER_VALUE, KEY_VALUE = (bytes.fromhex(x) for x in ("fea7d2763b4b9e79", "d7aa0f6d3061344e", "146e0be7abacd0d6"))
HMAC_KEY, HMAC_VALUE = (bytes.fromhex(x) for x in ("5fb2ad010cb9e1f6", "a0677f02b22c8433"))
SEGMENT, STANDARD_SPINS = 4096, 50_000


class WrongPassword(Encrypted):
    """The password doesn't open the document."""


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The S-box (inverses in GF(256), then an affine map), its inverse, and products by small factors."""
    power, log = [0] * 256, [0] * 256
    x = 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
    power[255] = power[0]
    times = lambda a, b: power[(log[a] + log[b]) % 255] if a and b else 0
    box = np.zeros(256, np.uint8)
    for v in range(256):
        q = power[(255 - log[v]) % 255] if v else 0
        out = 0x63
        for shift in range(5):
            out ^= ((q << shift) | (q >> (8 - shift))) & 0xFF
        box[v] = out
    inverse = np.zeros(256, np.uint8)
    inverse[box] = np.arange(256, dtype=np.uint8)
    return box, inverse, {k: np.array([times(v, k) for v in range(256)], np.uint8) for k in (2, 3, 9, 11, 13, 14)}


#: Where each byte of a block comes from when its rows are shifted (columns of four).
_ROWS = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])
_BACK = np.argsort(_ROWS)


class Aes:
    """AES over many blocks at once: arrays of (n, 16) bytes."""

    def __init__(self, key: bytes):
        box = _tables()[0]
        words = [list(key[i : i + 4]) for i in range(0, len(key), 4)]
        n, constant = len(words), 1
        self.rounds = n + 6
        while len(words) < 4 * (self.rounds + 1):
            w = list(words[-1])
            if len(words) % n == 0:
                w = [int(box[b]) for b in [*w[1:], w[0]]]
                w[0] ^= constant
                constant = (constant << 1) ^ (0x11B if constant & 0x80 else 0)
            elif n > 6 and len(words) % n == 4:
                w = [int(box[b]) for b in w]
            words.append([a ^ b for a, b in zip(words[-n], w, strict=True)])
        self.keys = np.array(words, np.uint8).reshape(-1, 16)

    @staticmethod
    def _mixed(s: np.ndarray, factors: tuple[int, ...]) -> np.ndarray:
        t = _tables()[2]
        c = s.reshape(-1, 4, 4)
        out = np.zeros_like(c)
        for row in range(4):
            for k in range(4):
                f = factors[(k - row) % 4]
                out[:, :, row] ^= c[:, :, k] if f == 1 else t[f][c[:, :, k]]
        return out.reshape(-1, 16)

    def encrypt(self, blocks: np.ndarray) -> np.ndarray:
        box = _tables()[0]
        s = blocks ^ self.keys[0]
        for r in range(1, self.rounds + 1):
            s = box[s][:, _ROWS]
            s = (self._mixed(s, (2, 3, 1, 1)) if r < self.rounds else s) ^ self.keys[r]
        return s

    def decrypt(self, blocks: np.ndarray) -> np.ndarray:
        inverse = _tables()[1]
        s = blocks ^ self.keys[self.rounds]
        for r in range(self.rounds - 1, -1, -1):
            s = inverse[s[:, _BACK]] ^ self.keys[r]
            s = self._mixed(s, (14, 11, 13, 9)) if r else s
        return s


def _blocks(data: bytes) -> np.ndarray:
    return np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)


def ecb_decrypt(key: bytes, data: bytes) -> bytes:
    return Aes(key).decrypt(_blocks(data)).tobytes()


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    blocks = _blocks(data)
    before = np.concatenate([_blocks(iv), blocks[:-1]]) if len(blocks) else blocks
    return (Aes(key).decrypt(blocks) ^ before).tobytes()


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    aes, last, out = Aes(key), _blocks(iv), []
    for block in _blocks(data):
        last = aes.encrypt(block[None] ^ last)
        out.append(last.tobytes())
    return b"".join(out)


def fit(data: bytes, size: int) -> bytes:
    return data[:size].ljust(size, b"\x36")


def spun(name: str, salt: bytes, password: str, spins: int) -> bytes:
    h = hashlib.new(name, salt + password.encode("utf-16-le")).digest()
    for i in range(spins):
        h = hashlib.new(name, struct.pack("<I", i) + h).digest()
    return h


def hash_name(text: str) -> str:
    return text.lower().replace("-", "").replace("sha160", "sha1")


def _agile(info: bytes, package: bytes, password: str) -> bytes:
    root = parse(info[8:])
    local = lambda tag: tag.rpartition(":")[2]
    data = next((n for n in root.walk() if local(n.tag) == "keyData"), None)
    key = next((n for n in root.walk() if local(n.tag) == "encryptedKey"), None)
    check = next((n for n in root.walk() if local(n.tag) == "dataIntegrity"), None)
    if data is None or key is None or data.get("cipherAlgorithm") != "AES" or data.get("cipherChaining") != "ChainingModeCBC":
        raise Encrypted("unsupported encryption")
    raw = lambda node, name: base64.b64decode(node.get(name) or "")
    name, bits, block = hash_name(key.get("hashAlgorithm") or "SHA1"), int(key.get("keyBits")) // 8, int(key.get("blockSize"))
    h = spun(name, raw(key, "saltValue"), password, min(10_000_000, int(key.get("spinCount"))))
    iv = fit(raw(key, "saltValue"), block)
    part = lambda mixed, field: cbc_decrypt(fit(hashlib.new(name, h + mixed).digest(), bits), iv, raw(key, field))
    probe = hashlib.new(name, part(VERIFIER_INPUT, "encryptedVerifierHashInput")[: len(raw(key, "saltValue"))]).digest()
    if part(VERIFIER_VALUE, "encryptedVerifierHashValue")[: len(probe)] != probe:
        raise WrongPassword("wrong password")
    secret = part(KEY_VALUE, "encryptedKeyValue")[:bits]
    own, salt, block = hash_name(data.get("hashAlgorithm") or "SHA1"), raw(data, "saltValue"), int(data.get("blockSize"))
    iv_of = lambda mixed: fit(hashlib.new(own, salt + mixed).digest(), block)
    if check is not None:
        size = int(data.get("hashSize"))
        mac_key = cbc_decrypt(secret, iv_of(HMAC_KEY), raw(check, "encryptedHmacKey"))[:size]
        mac = cbc_decrypt(secret, iv_of(HMAC_VALUE), raw(check, "encryptedHmacValue"))[:size]
        if hmac.new(mac_key, package, own).digest() != mac:
            raise Encrypted("the package has been changed")
    size = struct.unpack_from("<Q", package)[0]
    body = package[8:]
    parts = [cbc_decrypt(secret, iv_of(struct.pack("<I", i)), body[at : at + SEGMENT]) for i, at in enumerate(range(0, len(body), SEGMENT))]
    return b"".join(parts)[:size]


def standard_key(salt: bytes, password: str, size: int) -> bytes:
    h = hashlib.sha1(spun("sha1", salt, password, STANDARD_SPINS) + bytes(4)).digest()
    half = lambda pad: hashlib.sha1(bytes(a ^ pad for a in h.ljust(64, b"\0"))).digest()
    return (half(0x36) + half(0x5C))[:size]


def _standard(info: bytes, package: bytes, password: str) -> bytes:
    head = struct.unpack_from("<I", info, 8)[0]
    algorithm, _, bits = struct.unpack_from("<III", info, 12 + 8)
    if algorithm not in (0x660E, 0x660F, 0x6610):
        raise Encrypted("unsupported encryption")
    at = 12 + head
    salt, probe, value = info[at + 4 : at + 20], info[at + 20 : at + 36], info[at + 40 : at + 72]
    key = standard_key(salt, password, bits // 8)
    if hashlib.sha1(ecb_decrypt(key, probe)).digest() != ecb_decrypt(key, value)[:20]:
        raise WrongPassword("wrong password")
    return ecb_decrypt(key, package[8:])[: struct.unpack_from("<Q", package)[0]]


def decrypt(data: bytes, password: str) -> bytes:
    """The package inside an encrypted compound file."""
    box = open_compound(data)
    info, package = box.read("EncryptionInfo"), box.read("EncryptedPackage")
    if info is None or package is None or len(info) < 12 or len(package) < 8:
        raise NotAContainer("no encrypted package")
    major, minor = struct.unpack_from("<HH", info)
    try:
        if (major, minor) == (4, 4):
            return _agile(info, package, password)
        if minor == 2 and major in (2, 3, 4):
            return _standard(info, package, password)
    except (TypeError, struct.error, KeyError) as e:
        raise Encrypted(f"damaged encryption data: {e}") from e
    raise Encrypted("unsupported encryption")


# Binary documents: RC4 with a key for each block of 512 bytes ----------------------------------

BLOCK = 512
#: The version of the head of RC4 encryption, and the bytes of a document stream that stay plain.
RC4_VERSION, PLAIN_HEAD = (1, 1), 68


def rc4(key: bytes, data: bytes) -> bytes:
    state, j = list(range(256)), 0
    for i in range(256):
        j = (j + state[i] + key[i % len(key)]) & 255
        state[i], state[j] = state[j], state[i]
    out, i, j = bytearray(len(data)), 0, 0
    for at, byte in enumerate(data):
        i = (i + 1) & 255
        j = (j + state[i]) & 255
        state[i], state[j] = state[j], state[i]
        out[at] = byte ^ state[(state[i] + state[j]) & 255]
    return bytes(out)


def binary_key(password: str, salt: bytes) -> bytes:
    """The five bytes that the keys of all blocks are made of."""
    short = hashlib.md5(password.encode("utf-16-le")).digest()[:5]
    return hashlib.md5((short + salt) * 16).digest()[:5]


def in_blocks(data: bytes, key: bytes, plain: int = 0) -> bytes:
    """A stream decrypted, or encrypted, block by block; its first bytes stay as they are."""
    out = bytearray()
    for number in range(-(-len(data) // BLOCK)):
        own = hashlib.md5(key + number.to_bytes(4, "little")).digest()
        out += rc4(own, data[number * BLOCK : (number + 1) * BLOCK])
    out[:plain] = data[:plain]
    return bytes(out)


def unlock_binary(head: bytes, password: str) -> bytes:
    """The key of a binary document from its table's head; raises where the password is wrong."""
    if len(head) < 52 or tuple(int.from_bytes(head[k : k + 2], "little") for k in (0, 2)) != RC4_VERSION:
        raise Encrypted("unsupported encryption")
    key = binary_key(password, head[4:20])
    both = rc4(hashlib.md5(key + bytes(4)).digest(), head[20:52])
    if hashlib.md5(both[:16]).digest() != both[16:]:
        raise WrongPassword("wrong password")
    return key
