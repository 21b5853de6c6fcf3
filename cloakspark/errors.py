"""Errors. Wrong configurations are said on the driver, when an operator is built; wrong data become a row's error column."""

from __future__ import annotations


class CloakError(Exception):
    code = "error"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details


class ValidationError(CloakError):
    code = "validation"

    def __init__(self, path: str, message: str):
        super().__init__(f"{path}: {message}", path=path)
        self.path = path


class UnknownCategoryError(CloakError):
    code = "unknown-category"

    def __init__(self, category: str):
        super().__init__(f"unknown category {category!r}", category=category)


def _kind(name: str, code: str) -> type[CloakError]:
    return type(name, (CloakError,), {"code": code, "__module__": __name__})


UnsupportedStrategyError = _kind("UnsupportedStrategyError", "unsupported-strategy")
CryptoUnavailableError = _kind("CryptoUnavailableError", "crypto")
EncryptionError = _kind("EncryptionError", "encryption")
PresetError = _kind("PresetError", "preset")
AllowListError = _kind("AllowListError", "allow-list")
BatchError = _kind("BatchError", "batch")
KeyManagementError = _kind("KeyManagementError", "key-management")
VaultError = _kind("VaultError", "vault")
PolicyError = _kind("PolicyError", "policy")
AuditIntegrityError = _kind("AuditIntegrityError", "audit-integrity")
