"""What several test modules need."""

SMALL = "/root/testdata/sf0.001"
