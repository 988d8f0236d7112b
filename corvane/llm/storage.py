"""Written intermediate tables, as the rest of the library has them."""

from corvane.storage import BROADCAST_BYTES, dealt, few, new_path, remove, shared_dir, workspace, written

__all__ = ["BROADCAST_BYTES", "dealt", "few", "new_path", "remove", "shared_dir", "workspace", "written"]
