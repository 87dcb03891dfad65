"""Who a user is a tenant of, and how many tasks a tenant may have under way."""

from __future__ import annotations

import base64
import binascii
import hashlib
import hmac
import json
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Protocol

from millrace.errors import Denied, TooMany
from millrace.types import identifier


class Resolver(Protocol):
    def tenant(self, user: str, secret: str) -> str: ...


class StaticResolver:
    """Users by name, each with a tenant and, if it has one, a secret."""

    def __init__(self, users: Mapping[str, str | tuple[str, str]]):
        self.users = {u: (t, None) if isinstance(t, str) else t for u, t in users.items()}

    def tenant(self, user: str, secret: str) -> str:
        tenant, own = self.users.get(user, (None, None))
        if tenant is None or own is not None and not hmac.compare_digest(own.encode(), secret.encode()):
            raise Denied("unknown user or wrong secret")
        return identifier(tenant)


class TokenResolver:
    """Signed tokens (JWT, HS256 only) in the secret's place; the tenant is a claim, and a token that names a time to expire is refused after it."""

    def __init__(self, key: bytes, claim: str = "tenant", clock: Callable[[], float] = time.time):
        self.key, self.claim, self.clock = key, claim, clock

    def tenant(self, user: str, secret: str) -> str:
        try:
            head, body, signature = secret.split(".")
            signed = hmac.new(self.key, f"{head}.{body}".encode(), hashlib.sha256).digest()
            if not hmac.compare_digest(signed, _unpacked(signature)) or json.loads(_unpacked(head))["alg"] != "HS256":
                raise Denied("the token's signature is wrong")
            claims = json.loads(_unpacked(body))
            if "exp" in claims and not self.clock() < float(claims["exp"]):
                raise Denied("the token has expired")
            if claims.get("sub", user) != user:
                raise Denied("the token is another user's")
            return identifier(claims[self.claim])
        except (ValueError, KeyError, TypeError, AttributeError, binascii.Error) as e:
            raise Denied("not a token") from e


def _unpacked(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def signed(claims: dict, key: bytes) -> str:
    """A token with these claims."""
    parts = [base64.urlsafe_b64encode(json.dumps(x, separators=(",", ":")).encode()).rstrip(b"=").decode() for x in ({"alg": "HS256", "typ": "JWT"}, claims)]
    mark = hmac.new(key, ".".join(parts).encode(), hashlib.sha256).digest()
    return ".".join([*parts, base64.urlsafe_b64encode(mark).rstrip(b"=").decode()])


class FirstOf:
    """The first resolver that knows the user."""

    def __init__(self, resolvers: Sequence[Resolver]):
        self.resolvers = list(resolvers)

    def tenant(self, user: str, secret: str) -> str:
        for r in self.resolvers:
            try:
                return r.tenant(user, secret)
            except Denied:
                continue
        raise Denied("unknown user or wrong secret")


class Permits:
    """At most ``most`` jobs of a tenant at a time; the others wait, each tenant for its own ones only."""

    def __init__(self, most: int = 16):
        self.most = most
        self.busy: dict[str, int] = {}
        self.peak: dict[str, int] = {}
        self.free = threading.Condition()

    @contextmanager
    def hold(self, tenant: str, wait_s: float | None = None) -> Iterator[None]:
        with self.free:
            if not self.free.wait_for(lambda: self.busy.get(tenant, 0) < self.most, wait_s):
                raise TooMany(f"{tenant} has {self.most} jobs under way")
            self.busy[tenant] = self.busy.get(tenant, 0) + 1
            self.peak[tenant] = max(self.peak.get(tenant, 0), self.busy[tenant])
        try:
            yield
        finally:
            with self.free:
                self.busy[tenant] -= 1
                if not self.busy[tenant]:
                    del self.busy[tenant]
                self.free.notify_all()
