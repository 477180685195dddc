"""Text folders, manifests, JSON indexes and report files."""
