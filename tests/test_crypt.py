"""AES by its published examples, and packages encrypted here and read back."""

import base64
import hashlib
import hmac
import os
import struct

import numpy as np
import pytest

from paperloom.outputs import to_text
from paperloom.plans.documents import parse_one, read_document
from paperloom.sources import crypt
from paperloom.sources.docx import Encrypted
from paperloom.sources.markdown import to_docx
from tests.test_documents import compound

PLAIN = bytes.fromhex("00112233445566778899aabbccddeeff")


@pytest.mark.parametrize(("size", "want"), [(16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")])
def test_aes_examples(size, want):
    aes = crypt.Aes(bytes(range(size)))
    block = np.frombuffer(PLAIN, np.uint8)[None]
    assert aes.encrypt(block).tobytes().hex() == want
    assert aes.decrypt(aes.encrypt(block)).tobytes() == PLAIN


def agile(package, password, name="sha512", bits=32):
    salt, data_salt, secret = os.urandom(16), os.urandom(16), os.urandom(bits)
    h = crypt.spun(name, salt, password, 100)
    b64 = lambda x: base64.b64encode(x).decode()
    lock = lambda mixed, value: b64(crypt.cbc_encrypt(crypt.fit(hashlib.new(name, h + mixed).digest(), bits), salt, value.ljust(-(-len(value) // 16) * 16, b"\0")))
    iv = lambda mixed: crypt.fit(hashlib.new(name, data_salt + mixed).digest(), 16)
    body = struct.pack("<Q", len(package))
    for i, at in enumerate(range(0, len(package), 4096)):
        part = package[at : at + 4096]
        body += crypt.cbc_encrypt(secret, iv(struct.pack("<I", i)), part.ljust(-(-len(part) // 16) * 16, b"\0"))
    body = body.ljust(4096, b"\0")  # the test's compound files have no mini stream
    size = hashlib.new(name).digest_size
    mac_key = os.urandom(size)
    pad = lambda x: x.ljust(-(-len(x) // 16) * 16, b"\0")
    probe = os.urandom(16)
    label = {"sha512": "SHA512", "sha1": "SHA1", "sha256": "SHA-256"}[name]
    xml = (
        f'<encryption xmlns:p="k"><keyData saltSize="16" blockSize="16" keyBits="{bits * 8}" hashSize="{size}" cipherAlgorithm="AES" cipherChaining="ChainingModeCBC" hashAlgorithm="{label}" saltValue="{b64(data_salt)}"/>'
        f'<dataIntegrity encryptedHmacKey="{b64(crypt.cbc_encrypt(secret, iv(crypt.HMAC_KEY), pad(mac_key)))}" encryptedHmacValue="{b64(crypt.cbc_encrypt(secret, iv(crypt.HMAC_VALUE), pad(hmac.new(mac_key, body, name).digest())))}"/>'
        f'<keyEncryptors><keyEncryptor><p:encryptedKey spinCount="100" saltSize="16" blockSize="16" keyBits="{bits * 8}" hashSize="{size}" hashAlgorithm="{label}" saltValue="{b64(salt)}" '
        f'encryptedVerifierHashInput="{lock(crypt.VERIFIER_INPUT, probe)}" encryptedVerifierHashValue="{lock(crypt.VERIFIER_VALUE, hashlib.new(name, probe).digest())}" encryptedKeyValue="{lock(crypt.KEY_VALUE, secret)}"/></keyEncryptor></keyEncryptors></encryption>'
    )
    return body, struct.pack("<HHI", 4, 4, 0x40) + xml.encode()


@pytest.mark.parametrize(("name", "bits"), [("sha512", 32), ("sha1", 16), ("sha256", 24)])
def test_agile(name, bits):
    body, info = agile(to_docx("secret text " * 2000), "pässword", name, bits)
    data = compound({"EncryptedPackage": body, "EncryptionInfo": info})
    assert to_text(read_document(data, "pässword")).startswith("secret text")
    with pytest.raises(crypt.WrongPassword):
        read_document(data, "other")
    with pytest.raises(Encrypted):
        read_document(data)
    changed = bytearray(body)
    changed[40] ^= 1
    with pytest.raises(Encrypted, match="changed"):
        read_document(compound({"EncryptedPackage": bytes(changed), "EncryptionInfo": info}), "pässword")


def test_standard():
    package, salt, probe = to_docx("plain words " * 400), os.urandom(16), os.urandom(16)
    key = crypt.standard_key(salt, "pw", 16)
    seal = lambda x: crypt.Aes(key).encrypt(np.frombuffer(x.ljust(-(-len(x) // 16) * 16, b"\0"), np.uint8).reshape(-1, 16)).tobytes()
    head = struct.pack("<IIIIIIII", 0x24, 0, 0x660E, 0x8004, 128, 24, 0, 0)
    info = struct.pack("<HHI", 3, 2, 0x24) + struct.pack("<I", len(head)) + head + struct.pack("<I", 16) + salt + seal(probe) + struct.pack("<I", 20) + seal(hashlib.sha1(probe).digest())
    data = compound({"EncryptedPackage": struct.pack("<Q", len(package)) + seal(package), "EncryptionInfo": info})
    assert to_text(read_document(data, "pw")).startswith("plain words")
    row = parse_one(data, ("text",), "wrong")
    assert row["text"] is None and "WrongPassword" in row["error"]


def test_rc4_by_published_vectors():
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert crypt.rc4(b"Wiki", b"pedia").hex() == "1021bf0420"
    assert crypt.rc4(b"Secret", b"Attack at dawn").hex() == "45a01f645fc35b383552544b9bf5"


def locked(password, text):
    """A binary document as an encrypting writer leaves it."""
    import hashlib
    import struct

    from paperloom.sources.containers import open_compound
    from tests.doc_builder import compound, word_file

    box = open_compound(word_file(text))
    stream, table = bytearray(box.read("WordDocument")), box.read("1Table")
    salt, verifier = bytes(range(16)), bytes(range(100, 116))
    key = crypt.binary_key(password, salt)
    head = struct.pack("<HH", 1, 1) + salt + crypt.rc4(hashlib.md5(key + bytes(4)).digest(), verifier + hashlib.md5(verifier).digest())
    struct.pack_into("<H", stream, 10, struct.unpack_from("<H", stream, 10)[0] | 0x100)
    struct.pack_into("<I", stream, 14, len(head))
    clx = struct.unpack_from("<II", stream, 0x1A2)
    struct.pack_into("<II", stream, 0x1A2, clx[0] + len(head), clx[1])
    return compound({"WordDocument": crypt.in_blocks(bytes(stream), key, crypt.PLAIN_HEAD), "1Table": crypt.in_blocks(head + table, key, len(head))})


def test_binary_documents_by_password():
    from paperloom.outputs import to_text
    from paperloom.plans.documents import parse_one
    from paperloom.sources.doc import read_doc
    from paperloom.sources.docx import Encrypted

    text = "secret é words\r" + "line after line\r" * 90
    data = locked("pässword", text)
    assert to_text(read_doc(data, "pässword")) == text.replace("\r", "\n")
    with pytest.raises(crypt.WrongPassword):
        read_doc(data, "other")
    with pytest.raises(Encrypted, match="encrypted"):
        read_doc(data)
    assert parse_one(data, ("text",), "pässword")["text"].startswith("secret é") and "encrypted" in parse_one(data, ("text",))["error"]
