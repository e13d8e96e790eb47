"""Key versions for keyed digests, and envelope encryption. Keys reach tasks as the one row of a broadcast join, never as literals of a plan."""

from __future__ import annotations

import base64
import secrets
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.scalars import pads


@dataclass
class KeyRing:
    """HMAC keys by version; the highest is active, older ones serve reads. Version 0 is reserved for no key."""

    keys: dict[int, bytes] = field(default_factory=dict)

    def __post_init__(self):
        if 0 in self.keys:
            raise ValueError("key version 0 is reserved")

    @property
    def active(self) -> int:
        if not self.keys:
            raise ValueError("the ring holds no key")
        return max(self.keys)

    def held(self) -> list[bytes]:
        return [self.keys[v] for v in sorted(self.keys)]


def with_pads(df: DataFrame, keys: dict[str, bytes]) -> DataFrame:
    """The rows with a column per key that `hmac_hex` takes."""
    row = df.sparkSession.createDataFrame([tuple(map(bytearray, (x for k in keys.values() for x in pads(k))))], ", ".join(f"`{n} inner` binary, `{n} outer` binary" for n in keys))
    made = [F.struct(F.col(f"`{n} inner`").alias("inner"), F.col(f"`{n} outer`").alias("outer")).alias(n) for n in keys]
    return df.crossJoin(F.broadcast(row.select(*made)))


def with_data_keys(df: DataFrame, data_keys: dict[int, bytes], on: str, name: str = "__key") -> DataFrame:
    """The rows with the data key of their number in column `on`, null if it is not held; one short row per key is broadcast."""
    rows = df.sparkSession.createDataFrame([(n, bytearray(k)) for n, k in data_keys.items()], f"__n long, `{name}` binary")
    return df.join(F.broadcast(rows), F.col(on) == F.col("__n"), "left").drop("__n")


def encrypted(value: Column, data_key: Column) -> Column:
    """AES-256-GCM as base64: initialisation vector, ciphertext, tag."""
    return F.base64(F.aes_encrypt(value.cast("binary"), data_key, F.lit("GCM")))


def decrypted(stored: Column, data_key: Column) -> Column:
    """The text, or null without the key; a ciphertext that was changed fails."""
    return F.when(data_key.isNotNull(), F.aes_decrypt(F.unbase64(stored), data_key, F.lit("GCM")).cast("string"))


class Envelope:
    """RSA-OAEP (SHA-256 for both hashes) around data keys, and PKCS#1 v1.5 signatures, through the JVM's providers."""

    def __init__(self, spark: SparkSession, bits: int = 2048, public: str | None = None, private: str | None = None):
        """A new pair, or keys that `exported` gave; without the private one it wraps and verifies only."""
        self.jvm = spark._jvm
        if public is None:
            generator = self.jvm.java.security.KeyPairGenerator.getInstance("RSA")
            generator.initialize(bits)
            pair = generator.generateKeyPair()
            self.public, self.private = pair.getPublic(), pair.getPrivate()
            return
        spec, factory = self.jvm.java.security.spec, self.jvm.java.security.KeyFactory.getInstance("RSA")
        self.public = factory.generatePublic(spec.X509EncodedKeySpec(base64.b64decode(public)))
        self.private = factory.generatePrivate(spec.PKCS8EncodedKeySpec(base64.b64decode(private))) if private else None

    def exported(self) -> tuple[str, str | None]:
        """Public and private key as base64 of their standard encodings."""
        factory, kind = self.jvm.java.security.KeyFactory.getInstance("RSA"), self.jvm.java.lang.Class.forName
        made = [(self.public, "X509"), (self.private, "PKCS8")]
        return tuple(None if k is None else base64.b64encode(bytes(factory.getKeySpec(k, kind(f"java.security.spec.{name}EncodedKeySpec")).getEncoded())).decode() for k, name in made)

    def _cipher(self, mode: int, key):
        if key is None:
            raise ValueError("the private key is not held")
        spec = self.jvm.javax.crypto.spec
        parameters = spec.OAEPParameterSpec("SHA-256", "MGF1", self.jvm.java.security.spec.MGF1ParameterSpec.SHA256, spec.PSource.PSpecified.DEFAULT)
        cipher = self.jvm.javax.crypto.Cipher.getInstance("RSA/ECB/OAEPPadding")
        cipher.init(mode, key, parameters)
        return cipher

    @staticmethod
    def new_data_key() -> bytes:
        return secrets.token_bytes(32)

    def wrap(self, data_key: bytes) -> bytes:
        return bytes(self._cipher(1, self.public).doFinal(data_key))

    def unwrap(self, wrapped: bytes) -> bytes:
        return bytes(self._cipher(2, self.private).doFinal(wrapped))

    def rewrap(self, wrapped: bytes, newer: Envelope) -> bytes:
        """The same data key under a newer key pair; ciphertexts stay as they are."""
        return newer.wrap(self.unwrap(wrapped))

    def sign(self, message: bytes) -> bytes:
        if self.private is None:
            raise ValueError("the private key is not held")
        s = self.jvm.java.security.Signature.getInstance("SHA256withRSA")
        s.initSign(self.private)
        s.update(message)
        return bytes(s.sign())

    def verify(self, message: bytes, signature: bytes) -> bool:
        s = self.jvm.java.security.Signature.getInstance("SHA256withRSA")
        s.initVerify(self.public)
        s.update(message)
        try:
            return bool(s.verify(signature))
        except Exception as e:  # noqa: BLE001  a signature of another length is an error there
            if "SignatureException" in str(e):
                return False
            raise


@dataclass
class RsaRing:
    """Key pairs by version; the highest wraps and signs, all serve reads as far as their private keys are held."""

    pairs: dict[int, Envelope]

    @property
    def active(self) -> int:
        return max(self.pairs)

    def wrap(self, data_key: bytes) -> tuple[int, bytes]:
        return self.active, self.pairs[self.active].wrap(data_key)

    def unwrap(self, version: int, wrapped: bytes) -> bytes | None:
        """The data key, or None if that private key is not held."""
        pair = self.pairs.get(version)
        return pair.unwrap(wrapped) if pair and pair.private is not None else None

    def can_sign(self) -> bool:
        return self.pairs[self.active].private is not None

    def sign(self, message: bytes) -> tuple[int, bytes]:
        return self.active, self.pairs[self.active].sign(message)

    def verify(self, version: int, message: bytes, signature: bytes) -> bool:
        return version in self.pairs and self.pairs[version].verify(message, signature)
