"""Streaming: conversion of files as they arrive."""
