"""Column helpers. All of them are built-in Spark expressions except the
CRC-64/NVME digest in :mod:`vaultlens.functions.crc64`."""
