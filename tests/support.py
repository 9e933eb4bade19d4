"""Constants that several test modules share."""

SF_SMALL = "/root/testdata/sf0.001"
