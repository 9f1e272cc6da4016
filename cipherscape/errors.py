"""Errors with the codes and statuses that a service shows."""

from __future__ import annotations


class InventoryError(Exception):
    code, status = "internal_error", 500

    def body(self) -> dict:
        return {"error": {"code": self.code, "message": str(self)}}


def _error(name: str, code: str, status: int) -> type[InventoryError]:
    return type(name, (InventoryError,), {"code": code, "status": status, "__module__": __name__})


#: Fixed value: what clients are shown of an unknown error.
FAILED = "Scan execution failed."


def safe(error: BaseException) -> tuple[str, str]:
    """(code, message) of a failed scan that a client may see; an unknown error shows nothing of its own."""
    return (error.code, str(error)) if isinstance(error, InventoryError) else ("SCAN_EXECUTION_FAILED", FAILED)


ScanNotFound = _error("ScanNotFound", "SCAN_NOT_FOUND", 404)
FindingNotFound = _error("FindingNotFound", "FINDING_NOT_FOUND", 404)
ReviewItemNotFound = _error("ReviewItemNotFound", "REVIEW_ITEM_NOT_FOUND", 404)
InvalidReviewTransition = _error("InvalidReviewTransition", "INVALID_REVIEW_TRANSITION", 409)
InvalidJobTransition = _error("InvalidJobTransition", "INVALID_JOB_TRANSITION", 409)
InvalidRepositoryUrl = _error("InvalidRepositoryUrl", "INVALID_REPOSITORY_URL", 422)
InvalidCommitSha = _error("InvalidCommitSha", "INVALID_COMMIT_SHA", 422)
IngestionFailed = _error("IngestionFailed", "INGESTION_FAILED", 502)
