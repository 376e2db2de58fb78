"""Readers and writers: manifests, image files, histories, reports, exports."""
